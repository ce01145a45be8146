"""Page layout over tables of positioned blocks: running content, reading order, coverage, captions.

Blocks have ``doc_id, page, number, text, x0, y0, x1, y1`` in points from the top left; pages have
``doc_id, page, width, height``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import Box, covered_share, horizontal_overlap, intersection_area, margin_role, vertical_distance
from quire.functions.text import repeat_key

PAGE = ["doc_id", "page"]
#: What a caption begins with, and what mathematics looks like.
CAPTION = r"(?iu)^\s*(fig(ure)?\.?|table|рис(унок)?\.?|табл(ица)?\.?|схема|диаграмма)\s*[-–—:]?\s*\d+"
OPERATORS = r"[∫∑∏√∞]"
MATH_CHARACTER = r"[=+\-−×÷±∓∫∑∏√≤≥≈≠∞^_²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉∂∆∇]"
MATH_FONT = r"(?i)math|symbol|stix|cmr|cmsy"
#: What Unicode counts as letters and digits, numeric signs too.
ALPHANUMERIC = r"[\p{L}\p{N}]"


def running_content(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, number, role) of headers and footers: margin blocks whose text, numbers aside, recurs
    on at least max(2, half of the document's pages). Documents of one page have none."""
    sizes = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    placed = blocks.join(pages.select(*PAGE, "height"), PAGE).withColumn("role", margin_role(Box.of(), F.col("height")))
    placed = placed.where("role IS NOT NULL").withColumn("_k", repeat_key(F.col("text"))).where("_k <> ''")
    seen = placed.groupBy("doc_id", "role", "_k").agg(F.count_distinct("page").alias("_n"))
    kept = seen.join(sizes, "doc_id").where((F.col("n_pages") > 1) & (F.col("_n") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") / 2)))).select("doc_id", "role", "_k")
    return placed.join(kept, ["doc_id", "role", "_k"], "left_semi").select(*PAGE, "number", "role")


def formula_score(text: Column, fonts: Column | None = None, n_lines: Column | None = None) -> Column:
    """Evidence from 0 to 1 that a block is a formula: an equals sign .45, a large operator .35, two or more
    mathematical characters, and .08 or more for each letter or digit, .25, a mathematical font .35, at most
    120 characters .05. Empty texts, over 240 characters and over three lines score 0."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.length(t)
    math = F.regexp_count(t, F.lit(MATH_CHARACTER))
    score = F.when(F.contains(t, F.lit("=")), 0.45).otherwise(0.0) + F.when(t.rlike(OPERATORS), 0.35).otherwise(0.0)
    score += F.when((math >= 2) & (math / F.greatest(F.regexp_count(t, F.lit(ALPHANUMERIC)), F.lit(1)) >= 0.08), 0.25).otherwise(0.0)
    if fonts is not None:
        score += F.when(F.exists(fonts, lambda f: f.rlike(MATH_FONT)), 0.35).otherwise(0.0)
    score += F.when(n <= 120, 0.05).otherwise(0.0)
    out = (n == 0) | (n > 240)
    if n_lines is not None:
        out |= n_lines > 3
    return F.when(out, 0.0).otherwise(F.least(F.round(score, 6), F.lit(1.0)))


def classify_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``role, confidence``: running content .98, then captions .96, then formulas from .65, else
    paragraphs at .5."""
    running = running_content(blocks, pages).withColumnRenamed("role", "_role")
    score = formula_score(F.col("text"), F.col("fonts") if "fonts" in blocks.columns else None, F.col("n_lines") if "n_lines" in blocks.columns else None)
    out = blocks.join(running, [*PAGE, "number"], "left").withColumn("_f", score).withColumn("_c", F.col("text").rlike(CAPTION))
    role = F.when(F.col("_role").isNotNull(), F.col("_role")).when(F.col("_c"), "caption").when(F.col("_f") >= 0.65, "equation").otherwise("paragraph")
    sure = F.when(F.col("_role").isNotNull(), 0.98).when(F.col("_c"), 0.96).when(F.col("_f") >= 0.65, F.col("_f")).otherwise(0.5)
    return out.withColumns({"role": role, "confidence": sure}).drop("_role", "_f", "_c")


def gutters(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, gutter_left, gutter_right) of two-column pages.

    Of the blocks up to 62 % of the page wide, in the order of their centers, the widest gap between
    neighbours (the last of equals) parts them if it is at least max(24, 8 %), both sides overlap
    vertically, and the space between them is at least max(8, 2 %)."""
    p = pages.select(*PAGE, "width")
    narrow = blocks.join(p, PAGE).where((F.col("x1") - F.col("x0")) <= 0.62 * F.col("width")).withColumn("_c", (F.col("x0") + F.col("x1")) / 2)
    w = Window.partitionBy(*PAGE).orderBy("_c", "number")
    steps = narrow.withColumn("_rank", F.row_number().over(w)).withColumn("_gap", F.lead("_c").over(w) - F.col("_c"))
    widest = steps.where("_gap IS NOT NULL").groupBy(*PAGE).agg(F.max(F.struct("_gap", F.col("_rank").alias("_at"))).alias("_b"))
    widest = widest.select(*PAGE, F.col("_b._gap").alias("_wide"), F.col("_b._at").alias("_cut"))
    sides = steps.join(widest, PAGE).where(F.col("_wide") >= F.greatest(F.lit(24.0), 0.08 * F.col("width")))
    left = F.col("_rank") <= F.col("_cut")
    pick = lambda c, side, f: f(F.when(side, F.col(c)))
    parts = sides.groupBy(*PAGE).agg(
        pick("x1", left, F.max).alias("gutter_left"), pick("x0", ~left, F.min).alias("gutter_right"), F.max("width").alias("_w"),
        pick("y0", left, F.min).alias("_l0"), pick("y1", left, F.max).alias("_l1"), pick("y0", ~left, F.min).alias("_r0"), pick("y1", ~left, F.max).alias("_r1"),
    )
    both = F.least("_l1", "_r1") > F.greatest("_l0", "_r0")
    enough = F.col("gutter_right") - F.col("gutter_left") >= F.greatest(F.lit(8.0), 0.02 * F.col("_w"))
    return parts.where(both & enough).select(*PAGE, "gutter_left", "gutter_right")


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``column`` (null for blocks across the gutter), ``column_count`` and ``position`` (from 1).

    A block across the gutter is a barrier: what begins strictly above it comes first, the left column
    before the right one, each by (y0, x0, number). Pages without a gutter are one column in that order.
    Blocks without text are left out, from the gutter's finding too."""
    blocks = blocks.where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")
    g = blocks.join(gutters(blocks, pages), PAGE, "left")
    two = F.col("gutter_left").isNotNull()
    spans = two & (F.col("x0") < F.col("gutter_left")) & (F.col("x1") > F.col("gutter_right"))
    middle = (F.col("gutter_left") + F.col("gutter_right")) / 2
    column = F.when(~two, 0).when(~spans, ((F.col("x0") + F.col("x1")) / 2 >= middle).cast("int"))
    g = g.withColumns({"column": column, "column_count": F.when(two, 2).otherwise(1), "_bar": F.coalesce(spans, F.lit(False))})
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "number")
    # barriers are counted over the blocks at or above a place; a block level with a barrier follows it
    upto = Window.partitionBy(*PAGE).orderBy("y0").rangeBetween(Window.unboundedPreceding, 0)
    above = F.sum(F.col("_bar").cast("int")).over(upto)
    own = F.sum(F.col("_bar").cast("int")).over(w)
    band = F.when(F.col("_bar"), own).otherwise(above + 0.5)
    g = g.withColumn("_band", band)
    order = Window.partitionBy(*PAGE).orderBy("_band", F.coalesce("column", F.lit(-1)), "y0", "x0", "number")
    return g.withColumn("position", F.row_number().over(order)).drop("_bar", "_band", "gutter_left", "gutter_right")


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Blocks of which no table of the page covers half; blocks without an area are never covered."""
    t = tables.select(*PAGE, *[F.col(c).alias(f"t_{c}") for c in Box._fields])
    same = [blocks[k] == t[k] for k in PAGE]
    inside = covered_share(Box(*(blocks[c] for c in Box._fields)), Box(*(t[f"t_{c}"] for c in Box._fields))) >= share
    return blocks.join(t, [*same, inside], "left_anti")


def caption_targets(captions: DataFrame, targets: DataFrame, overlap: float = 0.25, reach: float = 72.0) -> DataFrame:
    """Add ``target`` to captions: the nearest image or table of the page with enough horizontal overlap and
    within reach; images before tables and then by number where distances are equal; null without one.

    ``targets``: doc_id, page, kind, number, box. Pages are the join key, so pairs stay within a page."""
    t = targets.select(*PAGE, F.col("kind").alias("t_kind"), F.col("number").alias("t_number"), *[F.col(c).alias(f"t_{c}") for c in Box._fields])
    a, b = Box(*(captions[c] for c in Box._fields)), Box.of("t_")
    pairs = captions.join(t, PAGE).withColumn("_d", vertical_distance(a, b)).where((horizontal_overlap(a, b) >= overlap) & (F.col("_d") <= reach))
    rank = F.struct(F.round("_d", 6).alias("d"), (F.col("t_kind") != "image").alias("k"), F.col("t_number").alias("n"))
    best = pairs.groupBy(*PAGE, "number").agg(F.min_by(F.concat_ws("-", "t_kind", F.col("t_number").cast("string")), rank).alias("target"))
    return captions.join(best, [*PAGE, "number"], "left")


_MERGED = "doc_id long, page int, source string, ix int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def merge_ocr(blocks: DataFrame, ocr: DataFrame, tables: DataFrame, pages: DataFrame, limit: float = 0.3) -> DataFrame:
    """The text layer with the recognised blocks that it lacks, by (y0, x0).

    A recognised block is added if its IoU with every block accepted before it and every table is at most
    ``limit``; order matters among recognised blocks, so a page is one group. A text layer of 200
    characters or 2 % of the page has confidence .95, else .5; recognised blocks keep theirs, to four
    places."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, found, tab = (rows[rows.kind == k].sort_values("ix") for k in ("text", "ocr", "table"))
        w, h = rows.width.iloc[0], rows.height.iloc[0]
        chars = len(" ".join(own.text.fillna("")).strip())
        area = ((own.x1 - own.x0).clip(lower=0) * (own.y1 - own.y0).clip(lower=0)).sum()
        good = chars >= 200 or (w * h > 0 and min(area / (w * h), 1) >= 0.02)
        taken = [tuple(r) for r in pd.concat([own, tab])[["x0", "y0", "x1", "y1"]].itertuples(index=False)]
        keep = []
        for r in found.itertuples():
            box = (r.x0, r.y0, r.x1, r.y1)
            if all(_iou(box, t) <= limit for t in taken):
                taken.append(box)
                keep.append(r.Index)
        out = pd.concat([own.assign(source="text", confidence=0.95 if good else 0.5), found.loc[keep].assign(source="ocr", confidence=found.loc[keep].confidence.round(4))])
        return out.sort_values(["y0", "x0", "source", "ix"])[["doc_id", "page", "source", "ix", "text", "x0", "y0", "x1", "y1", "confidence"]]

    none = F.lit(None)
    parts = [
        blocks.select(*PAGE, F.lit("text").alias("kind"), F.col("number").cast("int").alias("ix"), "text", *Box._fields, none.cast("double").alias("confidence")),
        ocr.select(*PAGE, F.lit("ocr").alias("kind"), F.col("ix").cast("int").alias("ix"), "text", *Box._fields, "confidence"),
        tables.select(*PAGE, F.lit("table").alias("kind"), F.col("number").cast("int").alias("ix"), none.cast("string").alias("text"), *Box._fields, none.cast("double").alias("confidence")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(pages.select(*PAGE, "width", "height"), PAGE)
    return rows.groupBy(*PAGE).applyInPandas(run, _MERGED)


def _iou(a: tuple, b: tuple) -> float:
    common = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union > 0 else 0.0


def accept_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, page, number, accepted) from cells (row_ix, cell_ix, text, strategy): at least two rows and
    columns, four filled cells and half of all filled; tables found by text alone need two dense rows (three
    quarters filled) and three quarters of their rows dense."""
    filled = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", 1).otherwise(0)
    key = [*PAGE, "number"]
    rows = cells.groupBy(*key, "strategy", "row_ix").agg(F.count("*").alias("_n"), F.sum(filled).alias("_f"), F.count_distinct("cell_ix").alias("_w"))
    t = rows.groupBy(*key, "strategy").agg(F.count("*").alias("_rows"), F.max("_w").alias("_cols"), F.sum("_f").alias("_filled"), F.sum("_n").alias("_all"), F.sum((F.col("_f") >= 0.75 * F.col("_n")).cast("int")).alias("_dense"))
    basic = (F.col("_rows") >= 2) & (F.col("_cols") >= 2) & (F.col("_filled") >= 4) & (F.col("_filled") >= 0.5 * F.col("_all"))
    dense = (F.col("strategy") != "text") | ((F.col("_dense") >= 2) & (F.col("_dense") >= 0.75 * F.col("_rows")))
    return t.select(*key, (basic & dense).alias("accepted"))


def regular_row_spacing(rows: DataFrame) -> DataFrame:
    """(doc_id, page, number, regular): no gap between a table's rows exceeds max(36, 2.5 median heights);
    heights count as 1 at least."""
    key = [*PAGE, "number"]
    gap = F.lead("y0").over(Window.partitionBy(*key).orderBy("y0", "y1")) - F.col("y1")
    h = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    t = rows.withColumns({"_g": gap, "_h": h}).groupBy(*key).agg(F.max("_g").alias("_g"), F.median("_h").alias("_m"))
    return t.select(*key, (F.coalesce("_g", F.lit(0.0)) <= F.greatest(F.lit(36.0), 2.5 * F.col("_m"))).alias("regular"))


def page_confidence(merged: DataFrame) -> DataFrame:
    """(doc_id, confidence): the mean over blocks, 0 without any."""
    return merged.groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def analyze_pages(blocks: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, plain): blocks outside tables in reading order, without running content, a line each."""
    free = outside_tables(blocks, tables)
    ordered = reading_order(free, pages).select(*PAGE, "number", "position")
    kept = classify_blocks(free, pages).where(~F.col("role").isin("header", "footer")).join(ordered, [*PAGE, "number"])
    lines = F.sort_array(F.collect_list(F.struct("page", "position", "text")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda s: s["text"]), "\n").alias("plain"))


def match_strokes(strokes: DataFrame, sides: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(page keys, side_id, style): cell sides that strokes of exactly one style lie on and cover.

    Strokes and sides have ``axis, at, start, end``; both are keyed by page and axis, and by ``at`` to the
    tolerance: a stroke goes to its own bucket and both neighbours."""
    cell = lambda c: F.floor(c / (2 * tolerance) + 0.5)
    s = strokes.select(*PAGE, "axis", F.col("at").alias("s_at"), F.col("start").alias("s0"), F.col("end").alias("s1"), "style").withColumn("_k", F.explode(F.array(cell(F.col("s_at")) - 1, cell(F.col("s_at")), cell(F.col("s_at")) + 1)))
    d = sides.withColumn("_k", cell(F.col("at")))
    # sizes are estimated without the exploded rows, so either side could be taken for small enough to be broadcast
    on = d.join(s.hint("merge"), [*PAGE, "axis", "_k"]).where((F.abs(F.col("at") - F.col("s_at")) <= tolerance) & (F.col("s0") < F.col("end")) & (F.col("s1") > F.col("start")))
    w = Window.partitionBy(*PAGE, "side_id").orderBy("s0", "s1")
    reach = F.greatest(F.coalesce(F.max("s1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("start")), F.col("start"))
    hole = F.greatest(F.least(F.col("s0"), F.col("end")) - reach, F.lit(0.0))
    sums = on.withColumn("_hole", hole).groupBy(*PAGE, "side_id").agg(F.min("style").alias("style"), F.max("style").alias("_other"), F.sum("_hole").alias("_holes"), F.max("s1").alias("_last"), F.max("end").alias("_end"))
    full = (F.col("_holes") + F.greatest(F.col("_end") - F.col("_last"), F.lit(0.0))) <= 0.0001
    return sums.where(full & (F.col("style") == F.col("_other"))).select(*PAGE, "side_id", "style")


def table_overlap_area(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, number, area): the largest area that a block shares with a table of its page."""
    t = tables.select(*PAGE, *[F.col(c).alias(f"t_{c}") for c in Box._fields])
    return blocks.join(t, PAGE).groupBy(*PAGE, "number").agg(F.max(intersection_area(Box.of(), Box.of("t_"))).alias("area"))


def infer_headings(paragraphs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Add ``level`` (0 for body text) from font sizes: the base is element n // 2 of the document's sorted
    sizes; a heading is 1.5 points larger, or bold with at most 90 characters. Levels are by thirds of the
    range of heading sizes (from .66, from .33), or by +6 and +3 points where all are equal."""
    sizes = paragraphs.groupBy(by).agg(F.array_sort(F.collect_list("size")).alias("_s")).select(by, F.element_at("_s", (F.floor(F.size("_s") / 2) + 1).cast("int")).alias("_base"))
    p = paragraphs.join(sizes, by)
    big = F.col("size") >= F.col("_base") + 1.5
    p = p.withColumn("_h", big | (F.col("bold") & (F.length("text") <= 90)))
    span = p.where("_h").groupBy(by).agg(F.min("size").alias("_lo"), F.max("size").alias("_hi"))
    p = p.join(span, by, "left")
    share = (F.col("size") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    ranged = F.when(share >= 0.66, 1).when(share >= 0.33, 2).otherwise(3)
    more = F.col("size") - F.col("_base")
    level = F.when(~F.col("_h"), 0).when(F.col("_hi") > F.col("_lo"), ranged).when(more >= 6, 1).when(more >= 3, 2).otherwise(3)
    return p.withColumn("level", level).drop("_base", "_h", "_lo", "_hi")


def group_pages(parts: DataFrame, kinds: dict[str, str], pages: DataFrame) -> DataFrame:
    """Pages with one array per kind of part (``kinds``: kind to column), empty where there are none."""
    own = parts.groupBy(*PAGE).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("number")))).alias(c) for k, c in kinds.items()])
    out = pages.join(own, PAGE, "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<int>")) for c in kinds.values()})


