"""What a paragraph, run or shape comes to: inheritance along styles, placeholders, themes and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import color
from quire.operators.graph import _nearest, ancestors

#: The kind of a master's placeholder for that of a layout.
MASTER_TYPES = {"ctrTitle": "title", "subTitle": "body", "obj": "body", "pic": "body", "chart": "body", "tbl": "body", "clipArt": "body", "dgm": "body", "media": "body"}


def effective_values(owners: DataFrame, styles: DataFrame, by: list[str], owner: str, values: list[str], unresolved: str | None = None) -> DataFrame:
    """(by, owner, values) of paragraphs or runs: their own value, else that of the nearest style that declares
    one, from ``style`` along ``base``. Where ``unresolved`` (a flag of both tables) comes first, null.

    Styles are resolved by themselves, once each, and then joined to their owners."""
    flag = (lambda c: F.coalesce(F.col(c), F.lit(False))) if unresolved else (lambda c: F.lit(False))
    found = lambda v: F.when(F.col(v).isNotNull() | flag(unresolved), F.struct(F.col(v).alias("v"), flag(unresolved).alias("bad")))
    of_style = _nearest(styles, "style", "base", by, {v: found(v) for v in values}).withColumnRenamed("node", "style")
    own = owners.select(*by, owner, "style", *[found(v).alias(f"_own_{v}") for v in values])
    out = own.join(of_style, [*by, "style"], "left")
    chosen = lambda v: F.coalesce(f"_own_{v}", v)
    return out.select(*by, owner, *[F.when(~F.coalesce(chosen(v)["bad"], F.lit(False)), chosen(v)["v"]).alias(v) for v in values])


def inherited_tabs(styles: DataFrame, tabs: DataFrame, defaults: DataFrame, by: list[str]) -> DataFrame:
    """(by, style, positions): tab stops of a style, sorted: the document's defaults, then those of the chain from
    the base down; ``clear`` takes a position away again. ``tabs``: (by, style, position, kind); ``defaults``
    without the style. Of several actions on a position the one nearest to the style counts."""
    chain = ancestors(styles, "style", "base", by)
    actions = chain.join(tabs.select(*by, F.col("style").alias("ancestor"), "position", "kind"), [*by, "ancestor"]).select(*by, F.col("node").alias("style"), "position", "kind", "depth")
    first = styles.select(*by, "style").join(defaults, by).select(*by, "style", "position", "kind", F.lit(1 << 30).alias("depth"))
    last = actions.unionByName(first).groupBy(*by, "style", "position").agg(F.min_by("kind", "depth").alias("kind"))
    kept = last.where("kind <> 'clear'").groupBy(*by, "style").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    return styles.select(*by, "style").join(kept, [*by, "style"], "left").withColumn("positions", F.coalesce("positions", F.array().cast("array<double>")))


def _unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no other row has, found by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in rest])
    return one.where("_n = 1").drop("_n")


def placeholder_chain(shapes: DataFrame, layouts: DataFrame, masters: DataFrame, by: list[str]) -> DataFrame:
    """Add ``layout_shape, master_shape`` to the placeholders (by, shape, layout, master, idx) of slides: the one
    shape of the layout with the same index (0 where there is none), and the one of the master with the kind
    that the layout's kind stands for. More than one match is none, and without the first there is no second."""
    idx = lambda c: F.coalesce(F.col(c), F.lit("0"))
    ls = _unique(layouts.select(*by, "layout", idx("idx").alias("idx"), F.col("shape").alias("layout_shape"), F.coalesce("kind", F.lit("obj")).alias("_kind")), [*by, "layout", "idx"])
    ms = _unique(masters.select(*by, "master", F.coalesce("kind", F.lit("obj")).alias("_kind"), F.col("shape").alias("master_shape")), [*by, "master", "_kind"])
    names = F.create_map(*[F.lit(x) for kv in MASTER_TYPES.items() for x in kv])
    own = shapes.withColumn("idx", idx("idx"))
    out = own.join(ls, [*by, "layout", "idx"], "left").withColumn("_kind", F.coalesce(F.try_element_at(names, F.col("_kind")), F.col("_kind")))
    return out.join(ms, [*by, "master", "_kind"], "left").drop("_kind")


def inherited_shapes(slides: DataFrame, layouts: DataFrame, shapes: DataFrame, by: list[str]) -> DataFrame:
    """(by, slide, layer, shape): what a slide shows of its master and layout: shapes that are neither
    placeholders nor hidden, the master's first. ``show_master`` of the slide takes both away, that of the
    layout the master's. ``shapes``: (by, part, shape, placeholder, hidden)."""
    s = slides.where(F.coalesce("show_master", F.lit(True))).select(*by, "slide", "layout").join(layouts.select(*by, "layout", "master", F.coalesce("show_master", F.lit(True)).alias("_m")), [*by, "layout"])
    layers = s.select(*by, "slide", F.explode(F.array(F.struct(F.lit(0).alias("layer"), F.when(F.col("_m"), F.col("master")).alias("part")), F.struct(F.lit(1).alias("layer"), F.col("layout").alias("part")))).alias("l")).select(*by, "slide", "l.*")
    plain = shapes.where(~F.coalesce("placeholder", F.lit(False)) & ~F.coalesce("hidden", F.lit(False))).select(*by, "part", "shape")
    return layers.join(plain, [*by, "part"]).select(*by, "slide", "layer", "shape")


def theme_colors(slides: DataFrame, layouts: DataFrame, masters: DataFrame, palette: DataFrame, by: list[str]) -> DataFrame:
    """(by, slide, name, hex): theme colors as a slide names them: its own color map, else the layout's, else the
    master's, into the palette (by, theme, slot, hex) of the master's theme. Maps are map<string,string>."""
    s = slides.select(*by, "slide", "layout", F.col("color_map").alias("_s")).join(layouts.select(*by, "layout", "master", F.col("color_map").alias("_l")), [*by, "layout"])
    s = s.join(masters.select(*by, "master", "theme", F.col("color_map").alias("_m")), [*by, "master"])
    named = s.select(*by, "slide", "theme", F.explode(F.coalesce("_s", "_l", "_m")).alias("name", "slot"))
    return named.join(palette, [*by, "theme", "slot"]).select(*by, "slide", "name", "hex")


def resolve_color(base: Column, modifiers: Column) -> Column:
    """struct(hex, alpha): a base color ``#rrggbb`` under its modifiers, array<struct<name, value>> in order, with
    values in thousandths of a percent: ``lumMod`` and ``lumOff`` on the lightness, ``tint`` and ``shade`` in linear
    light, ``alpha``; others change nothing. Null where the base is none. Components of a gray that a lightness
    modifier left last are cut, not rounded, to 8 bits. An expression in generated code, folded over the array."""
    c = color.parse_color(base)
    start = F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), F.lit(1.0).alias("alpha"), F.lit(False).alias("lum"))

    def step(acc: Column, m: Column) -> Column:
        v = m["value"].cast("double") / 100_000
        unit = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        rgb = [acc[n] for n in "rgb"]
        light = color.with_luminance(*rgb, F.when(m["name"] == "lumMod", v).otherwise(1.0), F.when(m["name"] == "lumOff", v).otherwise(0.0))
        is_lum = m["name"].isin("lumMod", "lumOff")
        linear = m["name"].isin("tint", "shade")
        new = [F.when(m["name"] == "tint", color.tint(x, unit)).when(m["name"] == "shade", color.shade(x, unit)).when(is_lum, y).otherwise(x) for x, y in zip(rgb, light, strict=True)]
        return F.struct(*[n.alias(k) for n, k in zip(new, "rgb", strict=True)], F.when(m["name"] == "alpha", unit).otherwise(acc["alpha"]).alias("alpha"), F.when(is_lum, True).when(linear, False).otherwise(acc["lum"]).alias("lum"))

    def end(acc: Column) -> Column:
        gray = acc["lum"] & (acc["r"] == acc["g"]) & (acc["g"] == acc["b"])
        cut = [F.when(gray, F.floor(acc[n] * 255) / 255).otherwise(acc[n]) for n in "rgb"]
        return F.struct(color.to_hex(*cut).alias("hex"), acc["alpha"].alias("alpha"))

    return F.when(c.isNotNull(), F.aggregate(F.coalesce(modifiers, F.array().cast("array<struct<name:string,value:double>>")), start, step, end))


def group_transform(off: Column, ext: Column, child_off: Column, child_ext: Column) -> Column:
    """struct(scale, move) along one axis from a group's children to the group's own space; the identity where any
    part is missing, and a scale of 1 where the children's extent is 0."""
    scale = F.when(child_ext != 0, ext / child_ext).otherwise(1.0)
    whole = off.isNotNull() & ext.isNotNull() & child_off.isNotNull() & child_ext.isNotNull()
    return F.when(whole, F.struct(scale.alias("scale"), (off - child_off * scale).alias("move"))).otherwise(F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("move")))


def page_boxes(shapes: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, shape, x, y, width, height) on the page of shapes in nested groups: the transforms of the groups around a
    shape, composed from the inside out. ``groups``: (by, grp, parent, x, y, cx, cy, child_x, child_y, child_cx, child_cy)."""
    g = groups.select(*by, F.col("grp").alias("ancestor"), group_transform(F.col("x"), F.col("cx"), F.col("child_x"), F.col("child_cx")).alias("_x"), group_transform(F.col("y"), F.col("cy"), F.col("child_y"), F.col("child_cy")).alias("_y"))
    chain = ancestors(groups, "grp", "parent", by).join(g, [*by, "ancestor"])
    steps = chain.groupBy(*by, "node").agg(F.sort_array(F.collect_list(F.struct("depth", "_x", "_y"))).alias("_t")).withColumnRenamed("node", "grp")

    def along(axis: str) -> Column:
        start = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("move"))
        return F.aggregate(F.coalesce("_t", F.array().cast("array<struct<depth:int,_x:struct<scale:double,move:double>,_y:struct<scale:double,move:double>>>")), start, lambda a, t: F.struct((a["scale"] * t[axis]["scale"]).alias("scale"), (a["move"] * t[axis]["scale"] + t[axis]["move"]).alias("move")))

    s = shapes.join(steps, [*by, "grp"], "left").withColumns({"_ax": along("_x"), "_ay": along("_y")})
    return s.select(*by, "shape", (F.col("x") * F.col("_ax.scale") + F.col("_ax.move")).alias("x"), (F.col("y") * F.col("_ay.scale") + F.col("_ay.move")).alias("y"), (F.col("width") * F.col("_ax.scale")).alias("width"), (F.col("height") * F.col("_ay.scale")).alias("height"))


def half_points(position: Column) -> Column:
    """A run's raise in points as whole half-points; null where it isn't one, within a ten-millionth, or out of range."""
    raw = F.round(position * 2)
    return F.when((F.abs(position * 2 - raw) <= 1e-7) & (F.abs(raw) < 2**31), raw.cast("long"))


def box_style(x: Column, y: Column, width: Column, height: Column, rotation: Column | None = None) -> Column:
    """The style of a positioned box: sizes above 0, its place unless that is the origin, its rotation unless 0."""
    pt = lambda name, v: F.concat(F.lit(name + ":"), F.regexp_replace(F.round(v, 3).cast("decimal(18,3)").cast("string"), r"\.?0+$", ""), F.lit("pt"))
    placed = (x != 0) | (y != 0)
    parts = [F.when(width > 0, pt("width", width)), F.when(height > 0, pt("height", height)), F.when(placed, "position:absolute"), F.when(placed, pt("left", x)), F.when(placed, pt("top", y))]
    if rotation is not None:
        parts.append(F.when(rotation != 0, F.concat(F.lit("transform:rotate("), F.regexp_replace(rotation.cast("decimal(18,3)").cast("string"), r"\.?0+$", ""), F.lit("deg)"))))
    return F.concat_ws(";", *parts)


def nearest_owner(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, owner): the nearest node at or above one that is an owner (``is_owner``), along ``parent``."""
    return _nearest(nodes, "node", "parent", by, {"owner": F.when(F.col("is_owner"), F.col("node"))})


def next_break(places: DataFrame, by: list[str], slack: float = 0.01) -> DataFrame:
    """(by, token, fault): of the blocks (token, offset, y1, bottom, forced) that end below their page, the first in
    the source; one that was forced to a new page already is a fault."""
    over = places.where(F.col("offset").isNotNull() & (F.col("y1") > F.col("bottom") + slack))
    first = over.groupBy(*by).agg(F.min_by(F.struct("token", "forced"), F.struct("offset", "token")).alias("_b"))
    return first.select(*by, F.col("_b.token").alias("token"), F.when(F.col("_b.forced"), "still-overflows").alias("fault"))


def keeps_words(cells: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, keeps): whether no inner column edge of a row runs through a word whose middle lies in the row.

    ``cells``: (keys, row_ix, x0, y0, x1, y1); ``words``: (keys, line, ix, x0, y0, x1, y1). A word that follows
    another of its line at less than a third of the lower height begins where that one ends; half a point is
    tolerated at both ends. A row reaches from its highest to its lowest cell, and a word belongs to the last
    row that begins at or above its middle."""
    bands = cells.groupBy(*keys, "row_ix").agg(F.min("y0").alias("_top"), F.max("y1").alias("_low"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("x0", "x1"))))).alias("_edges"))
    w = Window.partitionBy(*keys, "line").orderBy("ix")
    gap, low = F.col("x0") - F.lag("x1").over(w), F.least(F.col("y1") - F.col("y0"), F.lag(F.col("y1") - F.col("y0")).over(w))
    begun = words.withColumn("_start", F.when((gap >= 0) & (gap < low / 3), F.lag("x1").over(w)).otherwise(F.col("x0"))).withColumn("_mid", (F.col("y0") + F.col("y1")) / 2)
    at = begun.join(bands, keys).where(F.col("_top") <= F.col("_mid")).groupBy(*keys, "line", "ix").agg(F.max_by(F.struct("_low", "_edges", "_mid", "_start", "x1"), "_top").alias("_b")).where("_b._mid <= _b._low")
    inner = F.slice(F.col("_b._edges"), F.lit(2), F.greatest(F.size("_b._edges") - 2, F.lit(0)))
    cut = F.exists(inner, lambda e: (e > F.col("_b._start") + 0.5) & (e < F.col("_b.x1") - 0.5))
    bad = at.groupBy(*keys).agg(F.max(cut).alias("_cut"))
    return cells.select(*keys).distinct().join(bad, keys, "left").select(*keys, (~F.coalesce("_cut", F.lit(False))).alias("keeps"))


def name_order_faults(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, name, code) of entries (by, owner, rank, name) of a storage that don't stand behind the one before
    them: shorter names first, then by upper case; equal ones are duplicates."""
    key = F.struct(F.length("name").alias("n"), F.upper("name").alias("u"))
    before = F.lag(key).over(Window.partitionBy(*by, "owner").orderBy("rank"))
    code = F.when(key == before, "duplicate-name").when(key < before, "name-order")
    return entries.select(*by, "owner", "rank", "name", code.alias("code")).where("code IS NOT NULL")


def shifted_warnings(records: DataFrame, offset: Column, path: str = "path") -> DataFrame:
    """Records whose place in a list of warnings (``metadata.warnings[n]``) moves by an offset; others stay."""
    n = F.regexp_extract(path, r"^metadata\.warnings\[(\d+)\]$", 1)
    moved = F.concat(F.lit("metadata.warnings["), (n.try_cast("long") + offset).cast("string"), F.lit("]"))
    return records.withColumn(path, F.when(n != "", moved).otherwise(F.col(path)))


def document_blocks(blocks: DataFrame, tables: DataFrame, row_id: str) -> DataFrame:
    """(row_id, pos, kind, text, level, table_ix) of flat texts as documents: blocks in order, each linked table where
    its first link stands, tables without a link behind them, and a single paragraph of ``plain`` where there
    is nothing else. ``blocks``: (row_id, pos, type, text, level, table_ix, plain); ``tables``: (row_id, table_ix)."""
    linked = F.col("type") == "table"
    own = blocks.where(F.col("pos").isNotNull()).select(row_id, F.col("pos").cast("long").alias("pos"), F.when(linked, "table").when((F.col("type") == "heading") & (F.col("level") > 0), F.concat(F.lit("heading-"), F.col("level").cast("string"))).otherwise("paragraph").alias("kind"), F.when(~linked, F.col("text")).alias("text"), F.when(~linked, F.col("level")).alias("level"), F.when(linked, F.col("table_ix")).alias("table_ix"))
    used = own.where("table_ix IS NOT NULL").select(row_id, "table_ix").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    rest = tables.join(used, [row_id, "table_ix"], "left_anti").select(row_id, (F.lit(1 << 40) + F.col("table_ix")).alias("pos"), F.lit("table").alias("kind"), none("string").alias("text"), none("int").alias("level"), "table_ix")
    both = own.unionByName(rest)
    bare = blocks.groupBy(row_id).agg(F.max("plain").alias("text")).where("text <> ''").join(both.select(row_id).distinct(), row_id, "left_anti")
    both = both.unionByName(bare.select(row_id, F.lit(0).cast("long").alias("pos"), F.lit("paragraph").alias("kind"), "text", none("int").alias("level"), none("int").alias("table_ix")))
    return both.withColumn("pos", (F.row_number().over(Window.partitionBy(row_id).orderBy("pos")) - 1).cast("int"))


def to_tabular(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, tex): tables as LaTeX: left-aligned columns, a cell over several as ``multicolumn``; null for a table whose
    rows have different widths or a cell over several rows, which the environment doesn't have. Texts are escaped."""
    from quire.functions.text import escape_latex

    body = escape_latex(F.col("text"))
    cell = F.when(F.col("col_span") > 1, F.concat(F.lit("\\multicolumn{"), F.col("col_span").cast("string"), F.lit("}{l}{"), body, F.lit("}"))).otherwise(body)
    rows = cells.groupBy(*by, "row_ix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_ix", cell.alias("_t")))), lambda c: c["_t"]), " & ").alias("_r"), F.sum("col_span").alias("_w"), F.max("row_span").alias("_h"))
    t = rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_ix", "_r"))), lambda r: r["_r"]), " \\\\\n").alias("_b"), F.min("_w").alias("_lo"), F.max("_w").alias("_hi"), F.max("_h").alias("_h"))
    tex = F.concat(F.lit("\\begin{tabular}{"), F.repeat(F.lit("l"), F.col("_hi").cast("int")), F.lit("}\n"), "_b", F.lit(" \\\\\n\\end{tabular}"))
    return t.select(*by, F.when((F.col("_lo") == F.col("_hi")) & (F.col("_h") == 1), tex).alias("tex"))


def native_text(parts: DataFrame, row_id: str) -> DataFrame:
    """(row_id, tex): the rendered parts (pos, tex) in order, or null for a document with a part outside the profile."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "tex"))), lambda s: s["tex"])
    return parts.groupBy(row_id).agg(F.when(F.bool_and(F.col("tex").isNotNull()), F.array_join(lines, "\n\n")).alias("tex"))
