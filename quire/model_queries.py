"""Registered queries over the rich model: office packages with styles, shapes and themes; relations that complete them."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.core_queries import query, table
from quire.functions import text
from quire.operators import pages, styles
from quire.plans.scratch import Scratch
from quire.source_queries import _LINES, _docx, _pptx
from quire.sources import archive, build, clean, office, ooxml, sinks
from quire.sources.archive import build_archive

# ---------------------------------------------------------------- documents


def _styled_docx(k: int, family: str, size: int) -> bytes:
    """A document with a style on a base, a paragraph with its own format, a run with a color, and a section."""
    w = build._W
    bold = "<w:b/>" if size % 2 else '<w:b w:val="0"/>'
    base = f'<w:style w:type="paragraph" w:styleId="Base"><w:name w:val="heading {size % 6 + 1}"/><w:rPr><w:rFonts w:ascii="{html.escape(family)}"/><w:sz w:val="{2 * size}"/></w:rPr><w:pPr><w:ind w:left="{20 * size}"/></w:pPr></w:style>'
    own = f'<w:style w:type="paragraph" w:styleId="Own"><w:name w:val="own"/><w:basedOn w:val="Base"/><w:rPr>{bold}</w:rPr></w:style>'
    color = '<w:color w:val="FF0000"/>' if k % 3 == 0 else ""
    ind = f'<w:ind w:left="{40 * size}" w:hanging="20"/>' if k % 4 == 0 else ""
    tabs = f'<w:tabs><w:tab w:val="left" w:pos="{size * 20}"/></w:tabs>'
    body = f'<w:p><w:pPr><w:pStyle w:val="Own"/><w:jc w:val="center"/>{ind}<w:spacing w:before="120" w:line="360" w:lineRule="auto"/>{tabs}</w:pPr><w:r><w:rPr>{color}</w:rPr><w:t>text {k}</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b{k}</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:hyperlink><w:r><w:t>end</w:t></w:r></w:hyperlink></w:p>'
    section = f'<w:sectPr><w:pgSz w:w="{20 * (300 + size)}" w:h="8000"{" w:orient=" + chr(34) + "landscape" + chr(34) if k % 2 else ""}/><w:pgMar w:top="200" w:bottom="400" w:left="600" w:right="800"/><w:cols w:num="{k % 3 + 1}"/></w:sectPr>'
    word = build._WORD
    parts = [("word/document.xml", word + "document.main+xml", f'<w:document xmlns:w="{w}"><w:body>{body}{section}</w:body></w:document>'), ("word/styles.xml", word + "styles+xml", f'<w:styles xmlns:w="{w}">{base}{own}</w:styles>')]
    return build._package("word/document.xml", "", parts, {"word/document.xml": [("rId1", f"{build._R}/styles", "styles.xml")]})


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = build.binary_kernel(_styled_docx, F.col("p_partkey"), F.col("p_brand"), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("content"))


@query(r"""SELECT p_partkey, 'text ' || p_partkey AS text, p_brand AS family, p_size::DOUBLE AS size, p_size % 2 = 1 AS bold, CASE WHEN p_partkey % 3 = 0 THEN 'FF0000' END AS color FROM part""")
def docx_run_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with what they declare, else what their paragraph's style or its base does."""
    docs = Scratch(spark, "runs").keep(_styled(spark, sf_dir))
    runs = ooxml.office_table(docs, "blocks", "p_partkey").where("pos = 0").select("p_partkey", "style", F.posexplode("runs").alias("run", "r")).select("p_partkey", "style", "run", "r.*")
    found = styles.effective_values(runs, ooxml.office_table(docs, "styles", "p_partkey"), ["p_partkey"], "run", ["family", "size", "bold", "color"])
    return found.join(runs.select("p_partkey", "run", "text"), ["p_partkey", "run"]).drop("run")


@query(rf"""WITH {_LINES} SELECT doc_id, pos, text, CASE WHEN pos % 7 = 0 THEN pos % 3 + 1 ELSE 0 END::INT AS level FROM l""")
def docx_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of packages with the heading level that their styles give them."""
    docs = Scratch(spark, "headings").keep(_docx(spark, sf_dir))
    blocks, found = ooxml.office_table(docs, "blocks", "doc_id"), ooxml.office_table(docs, "styles", "doc_id")
    return ooxml.headings(blocks, found, "doc_id").select("doc_id", "pos", "text", "level")


@query(r"""SELECT p_partkey, 0 AS section, (300 + p_size)::DOUBLE AS width, 400.0::DOUBLE AS height, p_partkey % 2 = 1 AS landscape, 10.0::DOUBLE AS top, 40.0::DOUBLE AS right, (p_partkey % 3 + 1)::INT AS columns FROM part""")
def docx_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.office_table(_styled(spark, sf_dir), "sections", "p_partkey").select("p_partkey", "section", "width", "height", "landscape", "top", "right", "columns")


@query(r"""SELECT p_partkey, 'center' AS align, CASE WHEN p_partkey % 4 = 0 THEN 2 * p_size ELSE p_size END::DOUBLE AS left, CASE WHEN p_partkey % 4 = 0 THEN -1.0 END::DOUBLE AS first, 6.0::DOUBLE AS before, 1.5::DOUBLE AS line, 'auto' AS line_rule, p_size::DOUBLE AS tab FROM part""")
def paragraph_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs' own alignment, spacing and tabs, and the indent that counts."""
    docs = Scratch(spark, "formats").keep(_styled(spark, sf_dir))
    b = ooxml.office_table(docs, "blocks", "p_partkey").where("pos = 0")
    indent = styles.effective_values(b.select("p_partkey", "pos", "style", "left"), ooxml.office_table(docs, "styles", "p_partkey"), ["p_partkey"], "pos", ["left"])
    return b.drop("left").join(indent, ["p_partkey", "pos"]).select("p_partkey", "align", "left", "first", "before", "line", "line_rule", F.element_at("tabs", 1)["position"].alias("tab"))


@query(r"""SELECT p_partkey, pos, table_ix, row_ix, cell_ix, text FROM (SELECT p_partkey, 0 AS pos, NULL::INT AS table_ix, NULL::INT AS row_ix, NULL::INT AS cell_ix, 'text ' || p_partkey AS text FROM part UNION ALL SELECT p_partkey, 1, 0, 0, 0, 'a' FROM part UNION ALL SELECT p_partkey, 2, 0, 0, 1, 'b' || p_partkey FROM part UNION ALL SELECT p_partkey, 3, NULL, NULL, NULL, 'end' FROM part)""")
def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in order, with those of tables in their place."""
    return ooxml.office_table(_styled(spark, sf_dir), "blocks", "p_partkey").select("p_partkey", "pos", "table_ix", "row_ix", "cell_ix", "text")


@query(r"""SELECT p_partkey, 1::BIGINT AS tables, 1::BIGINT AS hyperlinks, 1::BIGINT AS sections, 0::BIGINT AS comments FROM part""")
def docx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _styled(spark, sf_dir).select("p_partkey", ooxml.read_features(F.col("content")).alias("f"))
    return f.select("p_partkey", *[F.try_element_at("f", F.lit(n)).alias(n) for n in ("tables", "hyperlinks", "sections", "comments")])


@query(rf"""WITH {_LINES}, d AS (SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[\\&%$#_{{}}~^<>|…]')) SELECT doc_id, sum((pos % 7 = 0)::INT)::BIGINT AS n_headings, sum((pos % 7 <> 0 AND pos % 5 = 0)::INT)::BIGINT AS n_items, sum(length(text))::BIGINT AS n_chars FROM l JOIN d USING (doc_id) GROUP BY doc_id""")
def docx_as_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages as LaTeX sources: their headings, items and characters."""
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[\\&%$#_{}~^<>|…]")).select("doc_id")
    made = Scratch(spark, "latex").keep(_docx(spark, sf_dir).join(docs, "doc_id", "left_semi"))
    b = ooxml.headings(ooxml.office_table(made, "blocks", "doc_id"), ooxml.office_table(made, "styles", "doc_id"), "doc_id")
    out = sinks.to_latex(b.select("doc_id", "pos", "text", "level", "list_level"), "doc_id").select("doc_id", F.decode("content", "UTF-8").alias("t"))
    body = F.regexp_replace(F.regexp_replace("t", r"(?s)^.*?\\begin\{document\}|\\end\{document\}\n$", ""), r"\\begin\{itemize\}|\\end\{itemize\}|\n|(?m)^\\item |\\(sub)*section\{|\}", "")
    return out.select("doc_id", F.regexp_count("t", F.lit(r"(?m)^\\(?:sub)*section\{")).cast("long").alias("n_headings"), F.regexp_count("t", F.lit(r"(?m)^\\item ")).cast("long").alias("n_items"), F.length(body).cast("long").alias("n_chars"))


@query(rf"""WITH {_LINES} SELECT doc_id, sha256(text) AS plain FROM documents""")
def restored_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages taken apart and put together again: their texts."""
    parts = archive.archive_parts(_docx(spark, sf_dir), "doc_id").select("doc_id", "name", "content")
    back = ooxml.restore_packages(parts, "doc_id").select("doc_id", office.read_docx(F.col("content")).alias("d"))
    return back.select("doc_id", F.sha2("d.plain", 256).alias("plain"))


# ---------------------------------------------------------------- presentations


@query(r"""SELECT conv_id, '/ppt/slides/slide' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '.xml' AS part, 0 AS shape, 'title' AS ph_type, role AS text FROM conversations UNION ALL SELECT conv_id, '/ppt/slides/slide' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '.xml', 1, NULL, text FROM conversations""")
def pptx_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.office_table(_pptx(spark, sf_dir), "shapes", "conv_id").where("kind = 'sp'").select("conv_id", "part", "shape", "ph_type", "text")


_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query(rf"""SELECT conv_id, string_agg('<section><div style="">' || role || '</div><div style="">' || replace({_ESC}, chr(10), '<br>') || '</div></section>', '' ORDER BY turn) AS html FROM conversations GROUP BY conv_id""")
def slides_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentations as pages of positioned boxes."""
    shapes = ooxml.office_table(_pptx(spark, sf_dir), "shapes", "conv_id")
    return ooxml.slides_to_html(shapes, "conv_id")


def _deck(k: int, size: int) -> bytes:
    """A presentation with a chart: two series of three cached points."""
    c = "http://schemas.openxmlformats.org/drawingml/2006/chart"
    points = lambda tag, values: f"<c:{tag}><c:strRef><c:strCache>" + "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in values) + f"</c:strCache></c:strRef></c:{tag}>"
    series = "".join(f"<c:ser>{points('tx', [(0, f's{s}')])}{points('cat', [(i, f'c{i}') for i in range(3)])}{points('val', [(i, size * (s + 1) + i) for i in range(3) if (k + i) % 5])}</c:ser>" for s in range(2))
    chart = f'<c:chartSpace xmlns:c="{c}"><c:chart><c:plotArea><c:barChart>{series}</c:barChart></c:plotArea></c:chart></c:chartSpace>'
    return build._package("ppt/presentation.xml", "", [("ppt/presentation.xml", build._SLIDES + "presentation.main+xml", f'<p:presentation xmlns:p="{build._P}"/>'), ("ppt/charts/chart1.xml", "application/vnd.openxmlformats-officedocument.drawingml.chart+xml", chart)], {})


@query(r"""SELECT p_partkey, 'barChart' AS kind, s::INT AS series, 's' || s AS series_name, i::INT AS idx, 'c' || i AS category, CASE WHEN (p_partkey + i) % 5 <> 0 THEN p_size * (s + 1) + i END::DOUBLE AS value FROM part, range(2) a(s), range(3) b(i)""")
def chart_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached points of charts in presentations, with gaps."""
    made = table(spark, sf_dir, "part").select("p_partkey", build.binary_kernel(_deck, F.col("p_partkey"), F.col("p_size")).alias("content"))
    return ooxml.office_table(made, "points", "p_partkey").drop("part")


_DECK = """sh AS (SELECT p_partkey // 20 AS deck, p_partkey % 20 AS n, p_size, p_partkey FROM part)"""


def _decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k / 20).cast("long").alias("deck"), (k % 20).alias("n"), "p_size", k)


@query(rf"""WITH {_DECK}, s AS (SELECT deck, n AS shape, (p_size % 5)::VARCHAR AS idx FROM sh WHERE n < 8), l AS (SELECT deck, n, CASE WHEN p_size % 6 > 0 THEN (p_size % 6)::VARCHAR ELSE '0' END AS idx, ['title', 'ctrTitle', 'pic', 'dt'][p_size % 4 + 1] AS kind FROM sh WHERE n >= 8 AND n < 13),
m AS (SELECT deck, n, ['title', 'body', 'dt', 'ftr'][p_size % 4 + 1] AS kind FROM sh WHERE n >= 13), lu AS (SELECT deck, idx, min(n) AS n, min(kind) AS kind FROM l GROUP BY deck, idx HAVING count(*) = 1), mu AS (SELECT deck, kind, min(n) AS n FROM m GROUP BY deck, kind HAVING count(*) = 1)
SELECT s.deck, s.shape, lu.n AS layout_shape, mu.n AS master_shape FROM s LEFT JOIN lu ON lu.deck = s.deck AND lu.idx = s.idx LEFT JOIN mu ON mu.deck = s.deck AND mu.kind = CASE lu.kind WHEN 'ctrTitle' THEN 'title' WHEN 'pic' THEN 'body' ELSE lu.kind END""")
def placeholder_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of slides with those of the layout and master that they stand on, where these are the only ones."""
    d, size = _decks(spark, sf_dir), F.col("p_size")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (size % 4 + 1).cast("int"))
    one = F.lit(1)
    shapes = d.where("n < 8").select("deck", F.col("n").alias("shape"), one.alias("layout"), one.alias("master"), F.when(size % 5 > 0, (size % 5).cast("string")).alias("idx"))
    layouts = d.where("n >= 8 AND n < 13").select("deck", one.alias("layout"), F.col("n").alias("shape"), F.when(size % 6 > 0, (size % 6).cast("string")).alias("idx"), pick("title", "ctrTitle", "pic", "dt").alias("kind"))
    masters = d.where("n >= 13").select("deck", one.alias("master"), F.col("n").alias("shape"), pick("title", "body", "dt", "ftr").alias("kind"))
    return styles.placeholder_chain(shapes, layouts, masters, ["deck"]).select("deck", "shape", "layout_shape", "master_shape")


@query(rf"""WITH {_DECK}, s AS (SELECT deck, n AS slide, n % 2 AS layout FROM sh WHERE n < 6 AND p_size % 4 <> 0), p AS (SELECT deck, n AS shape, n % 3 AS part FROM sh WHERE n >= 6 AND p_size % 3 <> 0 AND p_size % 5 <> 0)
SELECT s.deck, s.slide, 1 AS layer, p.shape FROM s JOIN p ON p.deck = s.deck AND p.part = s.layout UNION ALL SELECT s.deck, s.slide, 0, p.shape FROM s JOIN p ON p.deck = s.deck AND p.part = 2 WHERE s.layout = 0""")
def layout_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What slides show of their layouts and masters."""
    d, size = _decks(spark, sf_dir), F.col("p_size")
    slides = d.where("n < 6").select("deck", F.col("n").alias("slide"), (F.col("n") % 2).alias("layout"), (size % 4 != 0).alias("show_master"))
    layouts = d.select("deck").distinct().withColumn("layout", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))).withColumns({"master": F.lit(2).cast("long"), "show_master": F.when(F.col("layout") == 1, False)})
    shapes = d.where("n >= 6").select("deck", (F.col("n") % 3).alias("part"), F.col("n").alias("shape"), (size % 3 == 0).alias("placeholder"), F.when(size % 5 == 0, True).alias("hidden"))
    return styles.inherited_shapes(slides, layouts, shapes, ["deck"])


@query(rf"""WITH {_DECK}, s AS (SELECT deck, n AS slide, n % 2 AS layout, CASE WHEN p_size % 4 = 0 THEN 'accent2' END AS own FROM sh WHERE n < 6), c AS (SELECT deck, slide, coalesce(own, CASE WHEN layout = 1 THEN 'accent3' END, 'accent1') AS slot FROM s)
SELECT deck, slide, 'tx1' AS name, '#' || lpad(format('{{:x}}', ((deck * 97 + right(slot, 1)::INT * 4001) % 16777216)::BIGINT), 6, '0') AS hex FROM c""")
def theme_color_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The color that a slide's name stands for: by its own map, the layout's or the master's."""
    d = _decks(spark, sf_dir)
    to = lambda slot: F.create_map(F.lit("tx1"), F.lit(slot))
    slides = d.where("n < 6").select("deck", F.col("n").alias("slide"), (F.col("n") % 2).alias("layout"), F.when(F.col("p_size") % 4 == 0, to("accent2")).alias("color_map"))
    decks = d.select("deck").distinct()
    layouts = decks.withColumn("layout", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))).withColumns({"master": F.lit("m"), "color_map": F.when(F.col("layout") == 1, to("accent3"))})
    masters = decks.withColumns({"master": F.lit("m"), "theme": F.lit("t"), "color_map": to("accent1")})
    palette = decks.withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("deck", F.lit("t").alias("theme"), F.concat(F.lit("accent"), F.col("i").cast("string")).alias("slot"), F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("deck") * 97 + F.col("i") * 4001) % 16777216)), 6, "0")).alias("hex"))
    return styles.theme_colors(slides, layouts, masters, palette, ["deck"])


@query(r"""WITH c AS (SELECT p_partkey, p_partkey * 31 % 256 AS v, p_size * 2000 + 700 AS m FROM part), x AS (SELECT *, v / 255.0::DOUBLE AS l, CASE p_partkey % 4 WHEN 0 THEN 'lumMod' WHEN 1 THEN 'lumOff' WHEN 2 THEN 'tint' ELSE 'shade' END AS kind, least(m / 100000.0::DOUBLE, 1) AS w FROM c),
lin AS (SELECT *, CASE WHEN l <= 0.04045 THEN l / 12.92 ELSE power((l + 0.055) / 1.055, 2.4) END AS li FROM x), o AS (SELECT *, CASE kind WHEN 'lumMod' THEN floor(least(l * (m / 100000.0::DOUBLE), 1) * 255) / 255 WHEN 'lumOff' THEN floor(least(l + m / 100000.0::DOUBLE, 1) * 255) / 255 ELSE NULL END AS out, CASE kind WHEN 'tint' THEN li * w + 1 - w ELSE li * w END AS lo FROM lin),
r AS (SELECT *, round(coalesce(out, CASE WHEN lo <= 0.0031308 THEN lo * 12.92 ELSE 1.055 * power(lo, 1 / 2.4) - 0.055 END) * 255)::INT AS n FROM o)
SELECT p_partkey, '#' || lpad(format('{:x}', n), 2, '0') || lpad(format('{:x}', n), 2, '0') || lpad(format('{:x}', n), 2, '0') AS hex, 0.4::DOUBLE AS alpha FROM r""")
def resolved_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grays under a modifier each of lightness or linear light, and a transparency."""
    k = F.col("p_partkey")
    two = F.lpad(F.lower(F.hex(k * 31 % 256)), 2, "0")
    name = F.element_at(F.array(*map(F.lit, ("lumMod", "lumOff", "tint", "shade"))), (k % 4 + 1).cast("int"))
    change = lambda n, v: F.struct(n.alias("name"), v.cast("double").alias("value"))
    c = styles.resolve_color(F.concat(F.lit("#"), two, two, two), F.array(change(F.lit("alpha"), F.lit(40_000)), change(name, F.col("p_size") * 2000 + 700)))
    return table(spark, sf_dir, "part").select("p_partkey", c["hex"].alias("hex"), c["alpha"].alias("alpha"))


@query(r"""WITH RECURSIVE g AS (SELECT p_partkey // 20 AS deck, p_partkey % 20 AS grp, CASE WHEN p_partkey % 20 > 0 THEN (p_partkey % 20) // 2 END AS parent, p_size::DOUBLE AS x, 1.0::DOUBLE AS s FROM part WHERE p_partkey % 20 < 6),
c(deck, grp, up, sx, mx, sy, my) AS (SELECT deck, grp, parent, 2.0::DOUBLE, x - 2.0 * 5, 0.5::DOUBLE, x FROM g UNION ALL SELECT c.deck, c.grp, g.parent, c.sx * 2, c.mx * 2 + (g.x - 10), c.sy * 0.5, c.my * 0.5 + g.x FROM c JOIN g ON g.deck = c.deck AND g.grp = c.up),
f AS (SELECT * FROM c WHERE up IS NULL), s AS (SELECT p_partkey // 20 AS deck, p_partkey % 20 AS shape, CASE WHEN p_partkey % 20 < 18 THEN p_partkey % 20 % 6 END AS grp, (p_size * 3)::DOUBLE AS x FROM part WHERE p_partkey % 20 >= 6)
SELECT s.deck, shape, s.x * coalesce(sx, 1) + coalesce(mx, 0) AS x, 7 * coalesce(sy, 1) + coalesce(my, 0) AS y, 10 * coalesce(sx, 1) AS width, 4 * coalesce(sy, 1) AS height FROM s LEFT JOIN f ON f.deck = s.deck AND f.grp = s.grp""")
def grouped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the page of shapes in groups of groups."""
    d, n, size = _decks(spark, sf_dir), F.col("n"), F.col("p_size").cast("double")
    num = lambda v: F.lit(float(v))
    groups = d.where("n < 6").select("deck", n.alias("grp"), F.when(n > 0, (n / 2).cast("long")).alias("parent"), size.alias("x"), size.alias("y"), num(20).alias("cx"), num(5).alias("cy"), num(5).alias("child_x"), num(0).alias("child_y"), num(10).alias("child_cx"), num(10).alias("child_cy"))
    shapes = d.where("n >= 6").select("deck", n.alias("shape"), F.when(n < 18, n % 6).alias("grp"), (size * 3).alias("x"), num(7).alias("y"), num(10).alias("width"), num(4).alias("height"))
    return styles.page_boxes(shapes, groups, ["deck"])


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 THEN p_size * 2 + CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END END::BIGINT AS raised, 'width:' || p_size || 'pt' || CASE WHEN p_partkey % 2 = 0 THEN ';position:absolute;left:0.5pt;top:0pt' ELSE '' END AS style FROM part""")
def shape_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raised runs in half-points, and the styles of boxes."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    raised = size + F.when(k % 3 == 1, 0.5).when(k % 3 == 2, 0.3).otherwise(0.0)
    style = styles.box_style(F.when(k % 2 == 0, 0.5).otherwise(0.0), F.lit(0.0), size, F.lit(0.0))
    return table(spark, sf_dir, "part").select("p_partkey", styles.half_points(raised).alias("raised"), style.alias("style"))


# ---------------------------------------------------------------- relations


@query(r"""WITH RECURSIVE s AS (SELECT p_partkey // 50 AS doc_id, p_partkey % 50 AS style, CASE WHEN p_partkey % 50 > 0 THEN (p_partkey % 50) // 3 END AS base, p_size FROM part), t AS (SELECT doc_id, style, (p_size % 7)::DOUBLE AS position, CASE WHEN p_size % 4 = 0 THEN 'clear' ELSE 'left' END AS kind FROM s WHERE p_size % 3 = 0),
c(doc_id, style, anc, depth) AS (SELECT doc_id, style, style, 0 FROM s UNION ALL SELECT c.doc_id, c.style, s.base, depth + 1 FROM c JOIN s ON s.doc_id = c.doc_id AND s.style = c.anc WHERE s.base IS NOT NULL),
a AS (SELECT c.doc_id, c.style, t.position, t.kind, c.depth FROM c JOIN t ON t.doc_id = c.doc_id AND t.style = c.anc UNION ALL SELECT doc_id, style, 99.0, 'left', 1000000 FROM s), w AS (SELECT doc_id, style, position, arg_min(kind, depth) AS kind FROM a GROUP BY 1, 2, 3)
SELECT s.doc_id, s.style, coalesce(string_agg(position::INT::VARCHAR, ',' ORDER BY position) FILTER (kind <> 'clear'), '') AS positions FROM s LEFT JOIN w ON w.doc_id = s.doc_id AND w.style = s.style GROUP BY s.doc_id, s.style""")
def tab_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab stops of styles on chains of bases, with some taken away again."""
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select((k / 50).cast("long").alias("doc_id"), (k % 50).alias("style"), F.when(k % 50 > 0, ((k % 50) / 3).cast("long")).alias("base"), "p_size")
    tabs = s.where("p_size % 3 = 0").select("doc_id", "style", (F.col("p_size") % 7).cast("double").alias("position"), F.when(F.col("p_size") % 4 == 0, "clear").otherwise("left").alias("kind"))
    first = s.select("doc_id").distinct().withColumns({"position": F.lit(99.0), "kind": F.lit("left")})
    out = styles.inherited_tabs(s.drop("p_size"), tabs, first, ["doc_id"])
    return out.select("doc_id", "style", F.array_join(F.transform("positions", lambda p: p.cast("int").cast("string")), ",").alias("positions"))


@query(r"""WITH RECURSIVE n AS (SELECT p_partkey // 40 AS doc, p_partkey % 40 AS node, CASE WHEN p_partkey % 40 > 0 THEN (p_partkey % 40) // 2 END AS parent, p_size % 5 = 0 AS own FROM part), c(doc, node, up, depth) AS (SELECT doc, node, node, 0 FROM n UNION ALL SELECT c.doc, c.node, n.parent, depth + 1 FROM c JOIN n ON n.doc = c.doc AND n.node = c.up WHERE n.parent IS NOT NULL)
SELECT c.doc, c.node, arg_min(up, depth) FILTER (own) AS owner FROM c JOIN n ON n.doc = c.doc AND n.node = c.up GROUP BY c.doc, c.node""")
def issue_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest element that can own a finding."""
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select((k / 40).cast("long").alias("doc"), (k % 40).alias("node"), F.when(k % 40 > 0, ((k % 40) / 2).cast("long")).alias("parent"), (F.col("p_size") % 5 == 0).alias("is_owner"))
    return styles.nearest_owner(nodes, ["doc"])


@query(r"""SELECT page, 't' || n AS token, CASE WHEN forced THEN 'still-overflows' END AS fault FROM (SELECT p_partkey // 10 AS page, p_partkey % 10 AS n, p_size % 7 = 0 AS forced, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey * 7 % 10) AS r FROM part WHERE p_size * 10 > 400.01) WHERE r = 1""")
def flow_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of each page that ends below it."""
    k = F.col("p_partkey")
    places = table(spark, sf_dir, "part").select((k / 10).cast("long").alias("page"), F.concat(F.lit("t"), (k % 10).cast("string")).alias("token"), (k * 7 % 10).alias("offset"), (F.col("p_size") * 10.0).alias("y1"), F.lit(400.0).alias("bottom"), (F.col("p_size") % 7 == 0).alias("forced"))
    return styles.next_break(places, ["page"])


@query(r"""WITH w AS (SELECT p_partkey // 10 AS t, p_partkey % 10 AS ix, (p_partkey % 10 * 20)::DOUBLE AS x0, (p_partkey % 10 * 20 + p_size)::DOUBLE AS x1 FROM part), b AS (SELECT *, lag(x1) OVER (PARTITION BY t ORDER BY ix) AS px FROM w), s AS (SELECT *, CASE WHEN x0 - px >= 0 AND x0 - px < 10 / 3.0 THEN px ELSE x0 END AS st FROM b)
SELECT t, NOT bool_or(EXISTS (SELECT 1 FROM (VALUES (50.0), (110.0)) e(e) WHERE e > st + 0.5 AND e < x1 - 0.5)) AS keeps FROM s GROUP BY t""")
def table_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the column edges of a table leave its words whole."""
    k = F.col("p_partkey")
    words = table(spark, sf_dir, "part").select((k / 10).cast("long").alias("t"), F.lit(0).alias("line"), (k % 10).alias("ix"), (k % 10 * 20).cast("double").alias("x0"), F.lit(12.0).alias("y0"), (k % 10 * 20 + F.col("p_size")).cast("double").alias("x1"), F.lit(22.0).alias("y1"))
    edges = F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1")) for a, b in ((0.0, 50.0), (50.0, 110.0), (110.0, 300.0))])
    cells = words.select("t").distinct().withColumn("e", F.explode(edges)).select("t", F.lit(0).alias("row_ix"), "e.x0", F.lit(10.0).alias("y0"), "e.x1", F.lit(30.0).alias("y1"))
    return styles.keeps_words(cells, words, ["t"])


@query(r"""WITH e AS (SELECT p_partkey // 10 AS f, 0 AS owner, p_partkey % 10 AS rank, CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE upper(p_brand) END AS name FROM part), b AS (SELECT *, lag(length(name)) OVER w AS pl, lag(upper(name)) OVER w AS pn FROM e WINDOW w AS (PARTITION BY f, owner ORDER BY rank))
SELECT f, owner, rank, name, CASE WHEN length(name) = pl AND upper(name) = pn THEN 'duplicate-name' ELSE 'name-order' END AS code FROM b WHERE pl IS NOT NULL AND (length(name) < pl OR length(name) = pl AND upper(name) <= pn)""")
def directory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of storages that stand out of order."""
    k = F.col("p_partkey")
    entries = table(spark, sf_dir, "part").select((k / 10).cast("long").alias("f"), F.lit(0).alias("owner"), (k % 10).alias("rank"), F.when(F.col("p_size") % 2 == 0, F.lower("p_brand")).otherwise(F.upper("p_brand")).alias("name"))
    return styles.name_order_faults(entries, ["f"])


@query(r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'metadata.warnings[' || (p_size + 7) || ']' ELSE 'blocks[' || p_size || ']' END AS path FROM part""")
def shifted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("metadata.warnings["), F.col("p_size").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("blocks["), F.col("p_size").cast("string"), F.lit("]")))
    return styles.shifted_warnings(table(spark, sf_dir, "part").select("p_partkey", path.alias("path")), F.lit(7))


@query(r"""WITH b AS (SELECT p_partkey // 10 AS d, p_partkey % 10 AS pos, CASE WHEN p_size % 5 = 0 THEN 'table' WHEN p_size % 5 = 1 THEN 'heading' ELSE 'paragraph' END AS type, p_name AS text, p_size % 3 AS level, CASE WHEN p_size % 5 = 0 THEN p_partkey % 10 END AS table_ix FROM part WHERE p_partkey // 10 % 4 <> 0),
t AS (SELECT DISTINCT p_partkey // 10 AS d, i AS table_ix FROM part, range(10) r(i) WHERE p_partkey // 10 % 3 = 1 AND p_partkey // 10 % 4 <> 0),
u AS (SELECT d, pos, CASE WHEN type = 'table' THEN 'table' WHEN type = 'heading' AND level > 0 THEN 'heading-' || level ELSE 'paragraph' END AS kind, CASE WHEN type <> 'table' THEN text END AS text, CASE WHEN type <> 'table' THEN level END AS level, table_ix FROM b
  UNION ALL SELECT d, 1000 + table_ix, 'table', NULL, NULL, table_ix FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.d = t.d AND b.table_ix = t.table_ix)
  UNION ALL SELECT DISTINCT p_partkey // 10, 0, 'paragraph', 'plain ' || p_partkey // 10, NULL::INT, NULL::INT FROM part WHERE p_partkey // 10 % 4 = 0)
SELECT d, (row_number() OVER (PARTITION BY d ORDER BY pos) - 1)::INT AS pos, kind, text, level::INT AS level, table_ix::INT AS table_ix FROM u""")
def flat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat texts as documents: linked tables in place, others at the end, plain text where there is nothing else."""
    k, size = F.col("p_partkey"), F.col("p_size")
    d = (k / 10).cast("long")
    bare = d % 4 == 0
    kind = F.when(size % 5 == 0, "table").when(size % 5 == 1, "heading").otherwise("paragraph")
    own = lambda c: F.when(~bare, c)
    blocks = table(spark, sf_dir, "part").select(d.alias("d"), own((k % 10).cast("int")).alias("pos"), own(kind).alias("type"), own(F.col("p_name")).alias("text"), own((size % 3).cast("int")).alias("level"), own(F.when(size % 5 == 0, (k % 10).cast("int"))).alias("table_ix"), F.concat(F.lit("plain "), d.cast("string")).alias("plain"))
    tables = table(spark, sf_dir, "part").select(d.alias("d")).distinct().where("d % 3 = 1 AND d % 4 <> 0").withColumn("table_ix", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return styles.document_blocks(blocks, tables, "d")


@query(r"""WITH i AS (SELECT l_orderkey AS t, l_linenumber AS n, min(l_returnflag) AS a, min(l_linestatus) AS b, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)
SELECT t, CASE WHEN bool_and(s % 9 <> 0) THEN '\begin{tabular}{ll}' || chr(10) || string_agg(CASE WHEN s % 2 = 0 THEN '\multicolumn{2}{l}{' || a || '\&}' ELSE a || ' & ' || b END, ' \\' || chr(10) ORDER BY n) || ' \\' || chr(10) || '\end{tabular}' END AS tex FROM i GROUP BY t""")
def latex_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as LaTeX, with cells over two columns; those with a cell over two rows aren't."""
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("row_ix")).agg(F.min("l_returnflag").alias("a"), F.min("l_linestatus").alias("b"), F.min("l_suppkey").alias("s"))
    wide = F.col("s") % 2 == 0
    cell = lambda text_, span: F.struct(text_.alias("text"), F.lit(span).alias("col_span"))
    cells = i.withColumn("c", F.when(wide, F.array(cell(F.concat("a", F.lit("&")), 2))).otherwise(F.array(cell(F.col("a"), 1), cell(F.col("b"), 1))))
    cells = cells.select("t", "row_ix", F.when(F.col("s") % 9 == 0, 2).otherwise(1).alias("row_span"), F.posexplode("c").alias("cell_ix", "c")).select("t", "row_ix", "cell_ix", "row_span", "c.*")
    return styles.to_tabular(cells, ["t"])


@query(r"""SELECT p_partkey // 10 AS d, CASE WHEN bool_and(p_size % 11 <> 0) THEN string_agg(replace(p_brand, '#', '\#'), chr(10) || chr(10) ORDER BY p_partkey) END AS tex FROM part GROUP BY 1""")
def native_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as LaTeX where all their parts can be."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") / 10).cast("long").alias("d"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 11 != 0, text.escape_latex(F.col("p_brand"))).alias("tex"))
    return styles.native_text(parts, "d")


@query(r"""SELECT p_partkey, p_name || ' and ' || p_brand || ' link 50% x' AS plain, CASE WHEN p_size % 2 = 0 THEN 595.28 ELSE 612.0 END::DOUBLE AS width, 5::BIGINT AS n_formulas, 'twoside,' || CASE WHEN p_size % 2 = 0 THEN 'a4paper' ELSE 'letterpaper' END AS options FROM part""")
def latex_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, paper, formulas and class options of LaTeX sources made of the parts."""
    paper = F.when(F.col("p_size") % 2 == 0, "a4paper").otherwise("letterpaper")
    raw = F.concat(F.lit("\\documentclass[twoside, "), paper, F.lit("]{}\n% a comment\n\\begin{center}\\textbf{"), "p_name", F.lit("}~and "), F.replace("p_brand", F.lit("#"), F.lit("\\#")), F.lit(" $x^2$ \\[ y \\] $$z$$ \\begin{align*}a\\end{align*}\\href{u}{link} 50\\% \\noindent x\\end{center}"))
    d = table(spark, sf_dir, "part").select("p_partkey", raw.alias("r"))
    body = F.regexp_replace("r", r"\\documentclass\[[^\]]*\]\{\}", "")
    return d.select("p_partkey", text.strip_latex(body).alias("plain"), text.latex_paper_size(F.replace("r", F.lit("{}"), F.lit("{article}")))["width"].alias("width"), text.latex_formulas(F.col("r")).alias("n_formulas"), F.array_join(text.class_options(F.replace("r", F.lit("{}"), F.lit("{article}"))), ",").alias("options"))


@query(r"""SELECT p_partkey // 10 AS d, p_brand AS family, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY count(*) DESC, min(p_partkey))::INT AS place FROM part GROUP BY p_partkey // 10, p_brand""")
def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of each document by frequency, then first use."""
    runs = table(spark, sf_dir, "part").select((F.col("p_partkey") / 10).cast("long").alias("d"), F.col("p_brand").alias("family"), F.col("p_partkey").alias("pos"), F.lit(0).alias("ix"))
    return pages.families(runs, "d")


# ---------------------------------------------------------------- embedded XML and containers


@query(r"""SELECT p_partkey, 'rect' AS element, a AS attribute, CASE a WHEN 'fill' THEN '#' || lpad(format('{:x}', p_size), 2, '0') || '0000' ELSE '#00ff00' END AS color, CASE a WHEN 'fill' THEN 0.5 ELSE 1.0 END::DOUBLE AS alpha FROM part, (VALUES ('fill'), ('stroke')) t(a)""")
def svg_paints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colors of drawings, from attributes and styles."""
    svg = F.concat(F.lit('<svg><rect fill="#'), F.lpad(F.lower(F.hex("p_size")), 2, "0"), F.lit('0000" style="stroke: rgb(0, 255, 0); fill-opacity: 50%; color: url(#a)"/></svg>'))
    c = table(spark, sf_dir, "part").select("p_partkey", F.explode(clean.read_svg_colors(svg)).alias("c"))
    return c.select("p_partkey", "c.*")


@query(r"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || p_size || ' 9"><use href="#a" /></svg>' END AS xml, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 3 END::INT AS n_warnings FROM part""")
def clean_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings without what acts or leads elsewhere; those with declarations aren't kept."""
    size = F.col("p_size")
    svg = F.concat(F.when(size % 5 == 0, "<!DOCTYPE svg>").otherwise(""), F.lit('<svg viewbox="0 0 '), size.cast("string"), F.lit(' 9" onload="x()"><script>1</script><use href="#a" fill="url(http://x)"/></svg>'))
    c = table(spark, sf_dir, "part").select("p_partkey", clean.read_clean_xml(svg, "svg").alias("c"))
    return c.select("p_partkey", "c.xml", F.size("c.warnings").alias("n_warnings"))


def _nested(k: int) -> bytes:
    """An archive in an archive, to a depth by the key, with an image beside it."""
    data = build_archive([("text", b"x" * (k % 50)), ("i.png", build.render_png(3, 2))])
    for i in range(k % 4):
        data = build_archive([(f"in{i}.zip", data)])
    return data


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'too-deep' END AS fault, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 + 2 END::INT AS n, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 + 1 END::INT AS depth FROM part""")
def container_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers within containers, to a limited depth."""
    t = table(spark, sf_dir, "part").select("p_partkey", clean.read_container_tree(build.binary_kernel(_nested, F.col("p_partkey")), max_depth=3).alias("t"))
    return t.select("p_partkey", "t.fault", F.size("t.nodes").alias("n"), F.array_max(F.transform("t.nodes", lambda x: x["depth"])).alias("depth"))
