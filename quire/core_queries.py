"""Registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import color, geometry, text
from quire.operators import charts, dedup, fonts, graph, intervals, layout, pages, tables
from quire.plans.components import connected_components
from quire.plans.scratch import Scratch
from quire.sources import sinks
from quire.sources.epub import read_epub
from quire.sources.html import html_table
from quire.sources.tex import read_tex
from quire.sources.text import decode_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _since(unit: str):
    """Whole units of ``ts`` since 1970, for timestamps of either kind."""
    return F.expr(f"timestampdiff({unit}, cast(TIMESTAMP_NTZ'1970-01-01 00:00:00' as timestamp), cast(ts as timestamp))")


# ---------------------------------------------------------------- text


@query(r"""SELECT doc_id, i::INT - 1 AS line_ix, lines[i] AS line FROM (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)) AS lines FROM documents))""")
def txt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.posexplode(F.split(text.normalize_newlines(F.col("text")), "\n", -1)).alias("line_ix", "line")
    return table(spark, sf_dir, "documents").select("doc_id", lines)


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\r\n'))::BIGINT AS n_crlf, (len(text) - len(replace(text, chr(13), '')) - len(regexp_extract_all(text, '\r\n')))::BIGINT AS n_cr,
  (len(text) - len(replace(text, chr(10), '')) - len(regexp_extract_all(text, '\r\n')))::BIGINT AS n_lf FROM documents""")
def newline_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text.newline_counts(F.col("text")).items()])


_TYPOGRAPHY = "text || ' “x” — …'"


@query(rf"""SELECT doc_id, sha256(replace(translate({_TYPOGRAPHY}, '—–‘’“”«»', '--' || repeat(chr(39), 2) || repeat(chr(34), 4)), '…', '...')) AS fixed,
  (len({_TYPOGRAPHY}) - len(translate({_TYPOGRAPHY}, '—–‘’“”«»…', '')))::BIGINT AS n_replaced FROM documents""")
def typography_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed, n = text.fix_typography(F.concat("text", F.lit(" “x” — …")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fixed, 256).alias("fixed"), n.alias("n_replaced"))


_ESCAPED = "t"
for _a, _b in (("\\", "chr(1)"), *text.LATEX_SPECIALS):
    _ESCAPED = f"replace({_ESCAPED}, '{_a}', {_b if _b == 'chr(1)' else chr(39) + _b + chr(39)})"
_ESCAPED = f"replace(replace({_ESCAPED}, chr(1), '\\textbackslash{{}}'), '…', '\\dots{{}}')"


@query(rf"""SELECT id, kind, sha256({_ESCAPED}) AS escaped, length({_ESCAPED})::BIGINT AS n FROM (
  SELECT doc_id AS id, 'documents' AS kind, text || ' {{\x}} 50% a_b ~[c]^…' AS t FROM documents UNION ALL SELECT item_id, 'benchmark', text FROM benchmark)""")
def latex_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("kind"), F.concat("text", F.lit(" {\\x} 50% a_b ~[c]^…")).alias("t"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind"), F.col("text").alias("t"))
    out = docs.unionByName(items).withColumn("e", text.escape_latex(F.col("t")))
    return out.select("id", "kind", F.sha2("e", 256).alias("escaped"), F.length("e").cast("long").alias("n"))


@query(r"""SELECT id, trim(regexp_replace(translate(name, '<>:"/\|?*', '_________'), '_+', '_', 'g'), '_ ') AS safe FROM (
  SELECT page_id AS id, url AS name FROM pages UNION ALL SELECT p_partkey, p_name || ': ' || p_brand || '?' FROM part)""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(": "), "p_brand", F.lit("?")).alias("name"))
    return urls.unionByName(parts).select("id", text.sanitize_filename(F.col("name")).alias("safe"))


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t]+', ' ', 'g')) AS line FROM documents),
k AS (SELECT doc_id, regexp_replace(lower(line), '\b[0-9]+\b', '#', 'g') AS key FROM l WHERE line <> '')
SELECT key, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_lines FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= 3""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share, numbers aside."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    keyed = lines.withColumn("key", text.repeat_key(F.col("line"))).where("key <> ''")
    per_doc = keyed.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines")).where("n_docs >= 3")


@query(r"""SELECT doc_id, len(regexp_extract_all(t, '\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*[\[{]'))::BIGINT AS n_headings,
  len(regexp_extract_all(t, '\\includegraphics\b'))::BIGINT AS n_images, len(regexp_extract_all(t, '\\cite[a-z]*\b'))::BIGINT AS n_citations, len(regexp_extract_all(t, '\\item\b'))::BIGINT AS n_items,
  len(regexp_extract_all(t, '\\(?:ref|eqref|pageref|autoref)\b'))::BIGINT AS n_refs
FROM (SELECT doc_id, regexp_replace('\section{A} \cite{x} \item ' || lang || chr(10) || '% \item' || chr(10) || '\ref{y} ' || replace(replace(text, '%', ''), '\', ''), '(^|[^\\])%[^\n]*', '\1', 'g') AS t FROM documents)""")
def latex_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a LaTeX source made of each document."""
    plain = F.replace(F.replace(F.col("text"), F.lit("%"), F.lit("")), F.lit("\\"), F.lit(""))
    source = F.concat(F.lit("\\section{A} \\cite{x} \\item "), "lang", F.lit("\n% \\item\n\\ref{y} "), plain)
    m = text.latex_metrics(F.col("t"))
    return table(spark, sf_dir, "documents").select("doc_id", source.alias("t")).select("doc_id", *[m[n].alias(n) for n in ("n_headings", "n_images", "n_citations", "n_items", "n_refs")])


@query(r"""SELECT doc_id, i::INT - 1 AS row_ix, len(string_split(lines[i], ' | '))::INT AS n_cells, array_to_string(string_split(lines[i], ' | '), chr(9)) AS line FROM (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE contains(lines[i], ' | ')""")
def table_rows_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are table rows, as tab-joined cells."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("row_ix", "l")).where(F.contains("l", F.lit(" | ")))
    cells = F.split("l", "\\Q | \\E", -1)
    return lines.select("doc_id", "row_ix", F.size(cells).alias("n_cells"), F.array_join(cells, "\t").alias("line"))


@query(r"""SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS plain FROM conversations GROUP BY conv_id""")
def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("l"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(turns, lambda s: s["l"]), "\n").alias("plain"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '^(http|https|mailto):') OR starts_with(url, '#') THEN url END AS kept, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'mailto:a' || page_id || '@x.example' END AS other,
  regexp_extract(url, '^([A-Za-z]+):', 1) AS scheme FROM pages""")
def url_scheme_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("javascript:a"), "page_id")).otherwise(F.concat(F.lit("mailto:a"), "page_id", F.lit("@x.example")))
    return table(spark, sf_dir, "pages").select("page_id", text.allowed_link(F.col("url")).alias("kept"), text.allowed_link(other).alias("other"), F.regexp_extract("url", "^([A-Za-z]+):", 1).alias("scheme"))


# ---------------------------------------------------------------- duplicates and comparisons


@query(r"""SELECT sha256(text) AS sha256, count(*)::BIGINT AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.duplicate_groups(table(spark, sf_dir, "documents"), "text", "doc_id")
    return out.select("sha256", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(r"""SELECT doc_id, c AS canonical_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS c FROM documents WHERE text IS NOT NULL) WHERE c <> doc_id""")
def duplicate_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.canonical_rows(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(r"""WITH b AS (SELECT doc_id, text, n_chars FROM documents WHERE doc_id % 7 <> 0),
a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.text IS DISTINCT FROM b.text THEN 'content_changed' ELSE 'storage_changed' END AS status
FROM b FULL JOIN a ON a.doc_id = b.doc_id WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.text IS DISTINCT FROM b.text OR a.n_chars IS DISTINCT FROM b.n_chars""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots made of the documents: some missing on either side, some with another text or size."""
    docs = table(spark, sf_dir, "documents")
    item = lambda t, n: ("doc_id", dedup.content_hash(t).alias("sha256"), n.alias("stored"))
    before = docs.where("doc_id % 7 <> 0").select(*item(F.col("text"), F.col("n_chars")))
    other = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = docs.where("doc_id % 5 <> 0").select(*item(other, F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("n_chars"))))
    return dedup.diff_snapshots(before, after, "doc_id", "sha256", "stored")


@query(r"""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, ts DESC, event_id) AS r FROM events) WHERE r = 1""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return dedup.first_wins(events, ["user_id"], [rank, -_since("MICROSECOND"), F.col("event_id")]).drop("ts")


@query(r"""SELECT coalesce(c, s) AS nation, CASE WHEN c IS NULL THEN 'right' WHEN s IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_acctbal > 9000) FULL JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier) ON c = s""")
def key_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return dedup.set_algebra(c, s, ["nation"])


@query(r"""WITH h AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey),
w AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_returnflag = 'A')
SELECT l_orderkey, l_linenumber, coalesce(r <= n, false) AS matched FROM w LEFT JOIN h USING (l_partkey)""")
def multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    out = dedup.consume_as_multiset(items.where("l_returnflag = 'A'"), items.where("l_returnflag = 'R'"), ["l_partkey"], ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "matched")


# ---------------------------------------------------------------- charts


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals by status, less a constant so that signs differ."""
    orders = table(spark, sf_dir, "orders")
    month = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month")
    return orders.groupBy(F.col("o_orderstatus").alias("status"), month).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")) - 500000).cast("double").alias("value"))


_SERIES = "s AS (SELECT o_orderstatus AS status, strftime(o_orderdate, '%Y-%m') AS month, (sum(o_totalprice::DECIMAL(18,2)) - 500000)::DOUBLE AS value FROM orders GROUP BY 1, 2)"


@query(f"WITH {_SERIES} SELECT status, least(0.0, min(value)) AS low, CASE WHEN least(0.0, min(value)) = greatest(0.0, max(value)) THEN least(0.0, min(value)) + 1 ELSE greatest(0.0, max(value)) END AS high FROM s GROUP BY status")
def chart_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.chart_range(_series(spark, sf_dir), ["status"])


@query(rf"""WITH {_SERIES}, t AS (SELECT *, sum(value) OVER w AS total, sum(CASE WHEN value > 0 THEN value ELSE 0 END) OVER w AS up, sum(CASE WHEN value < 0 THEN -value ELSE 0 END) OVER w AS down FROM s WINDOW w AS (PARTITION BY month))
SELECT status, month, round(total, 2) AS total, round(100 * value / CASE WHEN (CASE WHEN value < 0 THEN down ELSE up END) = 0 THEN 1 WHEN value < 0 THEN down ELSE up END, 6) AS percent FROM t""")
def stack_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = charts.stack_percent(_series(spark, sf_dir), ["month"])
    return out.select("status", "month", F.round("total", 2).alias("total"), F.round("percent", 6).alias("percent"))


@query(rf"""WITH {_SERIES} SELECT status, month, round(1.5 * stddev_pop(value) OVER w, 3) AS by_deviation, round(stddev_pop(value) OVER w / sqrt(count(*) OVER w), 3) AS by_error, round(abs(value) * 0.05, 4) AS by_percent, 3.0::DOUBLE AS fixed
FROM s WINDOW w AS (PARTITION BY status)""")
def error_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _series(spark, sf_dir)
    for kind, amount, name, places in (("stddev", 1.5, "by_deviation", 3), ("stderr", 1, "by_error", 3), ("percentage", 5, "by_percent", 4), ("fixed", 3, "fixed", 1)):
        out = charts.error_bars(out, ["status"], kind, amount).withColumn(name, F.round("error", places)).drop("error")
    return out.drop("value")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    x = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return orders.groupBy(F.col("o_orderpriority").alias("priority"), x.alias("x")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / 1000).cast("double").alias("y"))


_DAILY = "d AS (SELECT o_orderpriority AS priority, datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS x, (sum(o_totalprice::DECIMAL(18,2)))::DOUBLE / 1000 AS y FROM orders GROUP BY 1, 2)"


@query(f"WITH {_DAILY} SELECT priority, round(coalesce(regr_slope(y, x), 0), 6) AS slope, round(coalesce(regr_intercept(y, x), avg(y), 0), 4) AS intercept FROM d GROUP BY priority")
def ols_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.linear_trend(_daily(spark, sf_dir), ["priority"]).select("priority", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"WITH {_DAILY} SELECT priority, round(exp(regr_intercept(ln(y), x)), 4) AS factor, round(regr_slope(ln(y), x), 9) AS rate FROM d WHERE y > 0 GROUP BY priority HAVING count(*) >= 2")
def exp_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.exponential_trend(_daily(spark, sf_dir), ["priority"]).select("priority", F.round("factor", 4).alias("factor"), F.round("rate", 9).alias("rate"))


@query(r"""WITH p AS (SELECT l_returnflag AS flag, l_linenumber::DOUBLE AS x, l_quantity AS y FROM lineitem),
s AS (SELECT flag, count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM p GROUP BY flag),
d AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM s)
SELECT flag, round((t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det, 6) AS c0, round((s0*(t1*s4-t2*s3) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / det, 6) AS c1, round((s0*(s2*t2-s3*t1) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / det, 6) AS c2 FROM d""")
def poly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y"))
    return charts.polynomial_trend(points, ["flag"], 2).select("flag", *[F.round(F.col("coefficients")[i], 6).alias(f"c{i}") for i in range(3)])


@query(r"""WITH d AS (SELECT event_type, ts::DATE AS day, sum(value::DECIMAL(18,2))::DOUBLE AS value FROM events GROUP BY 1, 2)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(avg(value) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM d""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return charts.moving_average(days, ["event_type"], ["day"], 5).select("event_type", "day", F.round("moving_avg", 6).alias("moving_avg"))


@query(rf"""WITH {_SERIES}, r AS (SELECT status, least(0.0, min(value)) AS low, greatest(0.0, max(value)) AS high FROM s GROUP BY status),
six AS (SELECT status, 'six' AS kind, i::INT AS tick_ix, high - (high - low) * i / 5 AS tick FROM r, range(6) t(i)),
u AS (SELECT status, 'unit' AS kind, (row_number() OVER (PARTITION BY status ORDER BY i) - 1)::INT AS tick_ix, low + 1000000 * i AS tick FROM r, range(1000) t(i) WHERE i <= round_even((high - low) / 1000000, 0) AND low + 1000000 * i <= high)
SELECT status, kind, tick_ix, round(tick, 3) AS tick FROM (SELECT * FROM six UNION ALL SELECT * FROM u)""")
def axis_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = charts.chart_range(_series(spark, sf_dir), ["status"])
    six = charts.axis_ticks(ranges, ["status"]).withColumn("kind", F.lit("six"))
    unit = charts.axis_ticks(ranges, ["status"], F.lit(1000000.0)).withColumn("kind", F.lit("unit"))
    return six.unionByName(unit).select("status", "kind", "tick_ix", F.round("tick", 3).alias("tick"))


@query(r"""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, event_id, (sum(CASE WHEN p IS NOT NULL AND p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS run FROM e""")
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return charts.runs_of(events, ["user_id"], ["event_id"], ["event_type"]).select("user_id", "event_id", "run")


@query(r"""WITH v AS (SELECT l_orderkey, l_linenumber AS i, max(l_suppkey)::VARCHAR AS v FROM lineitem GROUP BY 1, 2), o AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT o.l_orderkey, string_agg(coalesce(v, '-'), ' ' ORDER BY t.i) AS dense FROM o CROSS JOIN range(8) t(i) LEFT JOIN v ON v.l_orderkey = o.l_orderkey AND v.i = t.i GROUP BY o.l_orderkey""")
def dense_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by line number as a dense array of eight with gaps."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("idx")).agg(F.max("l_suppkey").cast("string").alias("value"))
    out = charts.dense_cache(items.withColumn("length", F.lit(8)), ["l_orderkey"])
    return out.select("l_orderkey", F.array_join("values", " ", "-").alias("dense"))


@query(r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN format('{:,.2f}', l_extendedprice) WHEN l_linenumber % 3 = 1 THEN format('{:.1f}%', l_discount * 100) ELSE format('{:g}', l_quantity) END AS shown FROM lineitem""")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    value = F.when(kind == 0, F.col("l_extendedprice")).when(kind == 1, F.col("l_discount")).otherwise(F.col("l_quantity"))
    code = F.when(kind == 0, "#,##0.00").when(kind == 1, "0.0%").otherwise("General")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", charts.format_number(value, code).alias("shown"))


# ---------------------------------------------------------------- intervals


def _stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _since("SECOND")
    return table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("start"), (s + (F.col("event_id") % 40) * 3600).alias("end"))


_STAYS = "e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + (event_id % 40) * 3600 AS e FROM events)"


@query(rf"""WITH {_STAYS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(s) AS start, max(e) AS "end" FROM i GROUP BY user_id, k""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(_stays(spark, sf_dir), ["user_id"])


@query(rf"""WITH {_STAYS}, b AS (SELECT *, 1704067200 + 86400 * 10 AS low, 1704067200 + 86400 * 12 AS high FROM e),
m AS (SELECT *, greatest(coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low), low) AS reach FROM b)
SELECT user_id, bool_and(s <= reach + 0.001 OR reach >= high - 0.001) AND max(e) >= max(high) - 0.001 AS covered FROM m GROUP BY user_id""")
def interval_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 1704067200
    rows = _stays(spark, sf_dir).withColumns({"low": F.lit(day + 86400 * 10), "high": F.lit(day + 86400 * 12)})
    return intervals.covers(rows, ["user_id"], "low", "high")


@query(rf"""WITH {_STAYS}, n AS (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nx FROM e)
SELECT user_id, s AS gap_start, nx AS gap_end, nx - s AS gap FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nx - s DESC, s) AS r FROM n WHERE nx IS NOT NULL) WHERE r = 1""")
def gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.largest_gap(_stays(spark, sf_dir), ["user_id"], "start")


@query(rf"""WITH {_STAYS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
u AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, k),
g AS (SELECT user_id, greatest(coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s), 1704067200), 1704067200) AS a, least(s, 1706659200) AS b FROM u UNION ALL SELECT user_id, greatest(max(e), 1704067200), 1706659200 FROM u GROUP BY user_id)
SELECT user_id, a AS start, b AS "end" FROM g WHERE a < b""")
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stays(spark, sf_dir).withColumns({"low": F.lit(1704067200).cast("long"), "high": F.lit(1706659200).cast("long")})
    return intervals.complement(rows, ["user_id"], "low", "high")


@query(rf"""WITH {_STAYS} SELECT user_id, event_id, coalesce(s < max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM e""")
def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlapping_spans(_stays(spark, sf_dir), ["user_id"]).select("user_id", "event_id", "overlaps")


# ---------------------------------------------------------------- pages


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html")


_BLOCKS = r"""body AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1), '(?s)<!--.*?-->', '', 'g'), '</?(a|b|br)( [^>]*)?>', '', 'g') AS b FROM pages),
seg AS (SELECT page_id, lang, i, regexp_extract(segs[i], '^<([a-z0-9]+)', 1) AS el, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(segs[i], '^<[^>]*>', ''), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, lang, segs, unnest(range(1, len(segs) + 1)) AS i FROM (SELECT page_id, lang, regexp_extract_all(b, '<(?:li|div|h1|p|footer)\b[^>]*>[^<]+') AS segs FROM body))),
blk AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, CASE WHEN el IN ('div', 'footer') THEN '' ELSE el END AS tag FROM seg WHERE text <> '')"""


@query(rf"""WITH {_BLOCKS}, k AS (SELECT *, regexp_replace(lower(text), '\b[0-9]+\b', '#', 'g') AS key FROM blk), r AS (SELECT key FROM k GROUP BY key HAVING count(DISTINCT page_id) >= greatest(2, 0.5 * (SELECT count(DISTINCT page_id) FROM k)))
SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS plain FROM k WHERE key NOT IN (SELECT key FROM r) GROUP BY page_id""")
def page_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's text without blocks that half of all pages have, numbers aside."""
    found = Scratch(spark, "pages").keep(pages.blocks(_pages(spark, sf_dir), "page_id").select("page_id", "pos", "text"))
    return pages.plain_text(pages.without_boilerplate(found, pages.boilerplate(found, "page_id")), "page_id")


@query(rf"""WITH {_BLOCKS} SELECT page_id, pos, 'paragraph' AS kind, tag, (tag = 'h1')::INT AS level, text, NULL::VARCHAR AS align, lang, CASE WHEN tag = 'li' THEN 0 END AS list_id, CASE WHEN tag = 'li' THEN 0 END AS list_level,
  CASE WHEN tag = 'li' THEN row_number() OVER (PARTITION BY page_id, tag ORDER BY pos)::INT END AS list_value, NULL::INT AS table_ix FROM blk""")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.blocks(_pages(spark, sf_dir), "page_id")


@query(rf"""WITH {_BLOCKS} SELECT page_id, pos, 0 AS ix, text, NULL::VARCHAR AS link, NULL::VARCHAR AS anchor, tag IN ('h1', 'p') AS bold, false AS italic, false AS underline, NULL::VARCHAR AS shift, 'black' AS color, CASE WHEN tag = 'h1' THEN 24 ELSE 12 END::DOUBLE AS size, NULL::VARCHAR AS family FROM blk""")
def html_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_table(_pages(spark, sf_dir), "runs", "page_id")


@query(r"""SELECT page_id, 'css,link' AS codes, (1 + len(list_distinct(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: left(h, 80)))))::BIGINT AS n_issues, false AS assessment_complete FROM pages""")
def html_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.ledger(html_table(_pages(spark, sf_dir), "issues", "page_id"), "page_id").withColumn("codes", F.array_join("codes", ","))


@query(r"""SELECT page_id, (unnest(range(1, len(h) + 1)) - 1)::INT AS ix, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_table(_pages(spark, sf_dir), "links", "page_id").select("page_id", "ix", "href")


@query(r"""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<h[1-6][ >]'))::BIGINT AS n_headings, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS n_paragraphs,
  len(regexp_extract_all(html, '<ul[ >]'))::BIGINT AS n_lists, len(regexp_extract_all(html, '<li[ >]'))::BIGINT AS n_items, len(regexp_extract_all(html, '<a href="[^#]'))::BIGINT AS n_hyperlinks,
  len(regexp_extract_all(html, '<table[ >]'))::BIGINT AS n_tables, len(regexp_extract_all(html, '<img[ >]'))::BIGINT AS n_images FROM pages""")
def html_tag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.inspection(_pages(spark, sf_dir), "page_id").select("page_id", "lang", "n_headings", "n_paragraphs", "n_lists", "n_items", "n_hyperlinks", "n_tables", "n_images")


@query(r"""WITH l AS (SELECT page_id, (page_id % 7)::VARCHAR AS target FROM pages UNION ALL SELECT page_id, 'top' FROM pages WHERE page_id % 2 = 0),
i AS (SELECT page_id, (k % 5)::VARCHAR AS id FROM pages, range(7) t(k) WHERE (page_id + k) % 3 <> 0)
SELECT l.page_id, '#' || target AS href, CASE WHEN count(i.id) = 1 OR (count(i.id) = 0 AND target = 'top') THEN 'ok' WHEN count(i.id) = 0 THEN 'missing' ELSE 'ambiguous' END AS status
FROM l LEFT JOIN i ON i.page_id = l.page_id AND i.id = l.target GROUP BY l.page_id, target""")
def link_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with planted fragment links and ids, parsed from HTML."""
    k = F.sequence(F.lit(0), F.lit(6))
    ids = F.transform(F.filter(k, lambda i: (F.col("page_id") + i) % 3 != 0), lambda i: F.concat(F.lit('<i id="'), (i % 5).cast("string"), F.lit('"></i>')))
    top = F.when(F.col("page_id") % 2 == 0, '<a href="#top">t</a>').otherwise("")
    html = F.concat(F.lit("<body><p>"), F.array_join(ids, ""), F.lit('<a href="#'), (F.col("page_id") % 7).cast("string"), F.lit('">x</a>'), top)
    made = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return pages.link_integrity(html_table(made, "links", "page_id"), html_table(made, "ids", "page_id"), "page_id").drop("ix")


@query(r"""WITH i AS (SELECT page_id, (k % 5)::VARCHAR AS ids FROM pages, range(7) t(k) WHERE (page_id + k) % 3 <> 0) SELECT page_id, ids, count(*)::BIGINT AS n FROM i GROUP BY page_id, ids HAVING count(*) > 1""")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.sequence(F.lit(0), F.lit(6))
    ids = F.transform(F.filter(k, lambda i: (F.col("page_id") + i) % 3 != 0), lambda i: F.concat(F.lit('<i id="'), (i % 5).cast("string"), F.lit('"></i>')))
    made = table(spark, sf_dir, "pages").select("page_id", F.array_join(ids, "").alias("html"))
    return pages.repeated_ids(html_table(made, "ids", "page_id"), "page_id")


@query(r"""SELECT o_orderkey AS page_id, (i * 3)::INT AS pos, level, 'h' || i AS text, (SELECT max(j * 3)::INT FROM (SELECT j, (o_orderkey * 7 + j * j * 3 + j) % 4 + 1 AS lj FROM range(8) u(j)) WHERE j < i AND lj < level) AS parent_pos
FROM (SELECT o_orderkey, i, ((o_orderkey * 7 + i * i * 3 + i) % 4 + 1)::INT AS level FROM orders, range(8) t(i))""")
def toc_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    level = (F.col("page_id") * 7 + F.col("i") * F.col("i") * 3 + F.col("i")) % 4 + 1
    heads = heads.select("page_id", (F.col("i") * 3).cast("int").alias("pos"), level.cast("int").alias("level"), F.concat(F.lit("h"), F.col("i").cast("string")).alias("text"))
    return pages.toc(heads, "page_id")


@query(r"""SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 + coalesce(CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey % 10 END, 1))::BIGINT AS list_value FROM lineitem""")
def list_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 10)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start"))
    return tables.number_items(items, ["l_orderkey"], ["l_linenumber"], "start").select("l_orderkey", "l_linenumber", F.col("list_value").cast("long").alias("list_value"))


@query(r"""WITH r AS (SELECT page_id, 'c' || page_id % 4 AS code, 'm' || page_id % 3 AS message, ['SEMANTIC', 'LOST', 'REJECTED', 'OPAQUE'][page_id % 4 + 1] AS state, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id % 5 END AS path FROM pages),
w AS (SELECT page_id, 'w' AS code, 'm' || k % 3 AS message, 'p' || page_id % 5 AS path FROM pages, range(4) t(k))
SELECT DISTINCT page_id, 'record' AS source, code, message, CASE WHEN state = 'REJECTED' THEN 'ERROR' ELSE 'LOSS' END AS severity FROM r WHERE state <> 'SEMANTIC'
UNION ALL SELECT DISTINCT page_id, 'warning', code, message, 'WARNING' FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.page_id = w.page_id AND r.path = w.path AND r.message = w.message)""")
def issue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id")
    name = lambda a, n: F.concat(F.lit(a), (F.col("page_id") % n).cast("string"))
    states = F.array(*map(F.lit, ("SEMANTIC", "LOST", "REJECTED", "OPAQUE")))
    records = p.select("page_id", name("c", 4).alias("code"), name("m", 3).alias("message"), F.element_at(states, (F.col("page_id") % 4 + 1).cast("int")).alias("state"), F.when(F.col("page_id") % 2 == 0, name("p", 5)).alias("path"))
    warnings = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("page_id", F.lit("w").alias("code"), F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("message"), name("p", 5).alias("path"))
    return pages.union_issues(records, warnings, "page_id")


# ---------------------------------------------------------------- layout over boxes made of the parts


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks on pages of 300 by 400 points, ten a page and four pages a document."""
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select((k / 40).cast("long").alias("doc_id"), ((k / 10).cast("long") % 4).cast("int").alias("page"), (k % 10).cast("int").alias("number"), F.col("p_name").alias("text"), (k * 37 % 200).cast("double").alias("x0"), (k * 53 % 360).cast("double").alias("y0"), (40 + k * 29 % 160).cast("double").alias("w"), (8 + k * 11 % 40).cast("double").alias("h"))
    return b.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h")}).drop("w", "h")


_BOXES = """b AS (SELECT p_partkey // 40 AS doc_id, (p_partkey // 10 % 4)::INT AS page, (p_partkey % 10)::INT AS number, p_name AS text, (p_partkey * 37 % 200)::DOUBLE AS x0, (p_partkey * 53 % 360)::DOUBLE AS y0,
  (p_partkey * 37 % 200 + 40 + p_partkey * 29 % 160)::DOUBLE AS x1, (p_partkey * 53 % 360 + 8 + p_partkey * 11 % 40)::DOUBLE AS y1 FROM part)"""


def _sheets(boxes: DataFrame) -> DataFrame:
    return boxes.select("doc_id", "page").distinct().withColumns({"width": F.lit(300.0), "height": F.lit(400.0)})


@query(rf"""WITH {_BOXES}, m AS (SELECT *, CASE WHEN y1 <= 48 THEN 'header' WHEN y0 >= 352 THEN 'footer' END AS role, lower(text) AS k FROM b),
n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM b GROUP BY doc_id),
s AS (SELECT doc_id, role, k FROM m JOIN n USING (doc_id) WHERE role IS NOT NULL GROUP BY doc_id, role, k, pages HAVING pages > 1 AND count(DISTINCT page) >= greatest(2, ceil(pages / 2)))
SELECT doc_id, page, number, role FROM m JOIN s USING (doc_id, role, k)""")
def margin_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return layout.running_content(boxes, _sheets(boxes))


@query(r"""WITH b AS (SELECT p_partkey // 40 AS doc_id, (p_partkey // 10 % 4)::INT AS page, (p_partkey % 10)::INT AS number, p_partkey * 53 % 360 AS y0, p_partkey // 10 % 2 = 0 AS three,
  CASE WHEN p_partkey // 10 % 2 = 0 THEN 20 + p_partkey % 3 * 100 WHEN p_partkey % 7 = 3 OR p_partkey % 2 = 0 THEN 20 ELSE 170 END::DOUBLE AS x0,
  CASE WHEN p_partkey // 10 % 2 = 0 THEN 80 + p_partkey % 3 * 100 WHEN p_partkey % 7 <> 3 AND p_partkey % 2 = 0 THEN 130 ELSE 280 END::DOUBLE AS x1 FROM part),
c AS (SELECT *, y0 + 10 AS y1, (x0 + x1) / 2 AS c, row_number() OVER (PARTITION BY doc_id, page ORDER BY (x0 + x1) / 2, number) AS r FROM b WHERE x1 - x0 <= 0.62 * 300),
g AS (SELECT *, lead(c) OVER (PARTITION BY doc_id, page ORDER BY c, number) - c AS gap FROM c),
w AS (SELECT doc_id, page, gap AS wide, r AS cut FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY gap DESC, r DESC) AS k FROM g WHERE gap IS NOT NULL) WHERE k = 1 AND gap >= 24),
s AS (SELECT doc_id, page, max(x1) FILTER (r <= cut) AS gl, min(x0) FILTER (r > cut) AS gr, min(y0) FILTER (r <= cut) AS l0, max(y1) FILTER (r <= cut) AS l1, min(y0) FILTER (r > cut) AS r0, max(y1) FILTER (r > cut) AS r1 FROM c JOIN w USING (doc_id, page) GROUP BY doc_id, page)
SELECT doc_id, page, gl AS gutter_left, gr AS gutter_right FROM s WHERE least(l1, r1) > greatest(l0, r0) AND gr - gl >= 8""")
def page_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two columns, and pages of three whose gaps are equal."""
    boxes = _columns(spark, sf_dir)
    k = F.col("doc_id") * 40 + F.col("page") * 10 + F.col("number")
    three = F.col("page") % 2 == 0
    at = lambda c, x: F.when(three, x + (k % 3) * 100.0).otherwise(F.col(c))
    boxes = boxes.withColumns({"x0": at("x0", 20.0), "x1": at("x1", 80.0)})
    return layout.gutters(boxes, _sheets(boxes))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-column pages: every seventh block runs across."""
    k = F.col("p_partkey")
    left = k % 2 == 0
    wide = k % 7 == 3
    b = table(spark, sf_dir, "part").select((k / 40).cast("long").alias("doc_id"), ((k / 10).cast("long") % 4).cast("int").alias("page"), (k % 10).cast("int").alias("number"), F.col("p_name").alias("text"), F.when(wide, 20.0).when(left, 20.0).otherwise(170.0).alias("x0"), (k * 53 % 360).cast("double").alias("y0"), F.when(wide, 280.0).when(left, 130.0).otherwise(280.0).alias("x1"))
    return b.withColumn("y1", F.col("y0") + 10.0)


@query(r"""WITH b AS (SELECT p_partkey // 40 AS doc_id, (p_partkey // 10 % 4)::INT AS page, (p_partkey % 10)::INT AS number, CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE (p_partkey % 2)::INT END AS col, CASE WHEN p_partkey % 7 = 3 OR p_partkey % 2 = 0 THEN 20 ELSE 170 END AS x0, p_partkey * 53 % 360 AS y0 FROM part),
n AS (SELECT *, (SELECT count(*) FROM b s WHERE s.doc_id = b.doc_id AND s.page = b.page AND s.col IS NULL AND (s.y0 < b.y0 OR s.y0 = b.y0 AND (s.x0, s.number) < (b.x0, b.number))) AS before, (SELECT count(*) FROM b s WHERE s.doc_id = b.doc_id AND s.page = b.page AND s.col IS NULL AND s.y0 <= b.y0) AS upto FROM b)
SELECT doc_id, page, number, col AS "column", row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN col IS NULL THEN before + 1 ELSE upto + 0.5 END, coalesce(col, -1), y0, x0, number)::INT AS position FROM n""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _columns(spark, sf_dir)
    return layout.reading_order(boxes, _sheets(boxes)).select("doc_id", "page", "number", "column", "position")


@query(rf"""WITH {_BOXES} SELECT doc_id, page, number FROM b WHERE number >= 3 AND NOT EXISTS (SELECT 1 FROM b t WHERE t.doc_id = b.doc_id AND t.page = b.page AND t.number < 3
  AND greatest(least(b.x1, t.x1) - greatest(b.x0, t.x0), 0) * greatest(least(b.y1, t.y1) - greatest(b.y0, t.y0), 0) >= 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0))""")
def outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return layout.outside_tables(boxes.where("number >= 3"), boxes.where("number < 3")).select("doc_id", "page", "number")


@query(rf"""WITH {_BOXES}, p AS (SELECT a.doc_id, a.page, a.number, t.number AS tn, CASE WHEN t.number < 5 THEN 'image' ELSE 'table' END AS kind, least(abs(a.y0 - t.y1), abs(t.y0 - a.y1)) AS d,
  greatest(least(a.x1, t.x1) - greatest(a.x0, t.x0), 0) / least(a.x1 - a.x0, t.x1 - t.x0) AS o FROM b a JOIN b t USING (doc_id, page) WHERE a.number < 3 AND t.number >= 3),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, number ORDER BY round(d, 6), kind <> 'image', tn) AS r FROM p WHERE o >= 0.25 AND d <= 72)
SELECT b.doc_id, b.page, b.number, kind || '-' || tn AS target FROM b LEFT JOIN best ON best.doc_id = b.doc_id AND best.page = b.page AND best.number = b.number AND r = 1 WHERE b.number < 3""")
def nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    targets = boxes.where("number >= 3").withColumn("kind", F.when(F.col("number") < 5, "image").otherwise("table"))
    return layout.caption_targets(boxes.where("number < 3"), targets).select("doc_id", "page", "number", "target")


@query(rf"""WITH {_BOXES}, p AS (SELECT a.doc_id, a.page, a.number AS na, t.number AS nb, greatest(least(a.x1, t.x1) - greatest(a.x0, t.x0), 0) * greatest(least(a.y1, t.y1) - greatest(a.y0, t.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (t.x1 - t.x0) * (t.y1 - t.y0) AS ta FROM b a JOIN b t USING (doc_id, page) WHERE a.number < t.number)
SELECT doc_id, page, na, nb, round(i / (aa + ta - i), 9) AS iou FROM p WHERE i > 0""")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _boxes(spark, sf_dir).drop("text")
    b = a.select("doc_id", "page", F.col("number").alias("nb"), *[F.col(c).alias(f"b_{c}") for c in geometry.Box._fields])
    pairs = a.withColumnRenamed("number", "na").join(b, ["doc_id", "page"]).where("na < nb")
    return pairs.withColumn("iou", F.round(geometry.iou(geometry.Box.of(), geometry.Box.of("b_")), 9)).where("iou > 0").select("doc_id", "page", "na", "nb", "iou")


_OCR = "(SELECT bool_and(coalesce(i / nullif(u - i, 0), 0) <= 0.3) FROM (SELECT greatest(least(o.x1, t.x1) - greatest(o.x0, t.x0), 0) * greatest(least(o.y1, t.y1) - greatest(o.y0, t.y0), 0) AS i, (o.x1 - o.x0) * (o.y1 - o.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) AS u FROM {0} t WHERE t.doc_id = o.doc_id AND t.page = o.page))"
_OCR_STEPS = "a0 AS (SELECT * FROM b WHERE number % 2 = 0 OR number = 9)"
for _n, _k in enumerate((1, 3, 5, 7)):
    _OCR_STEPS += f", a{_n + 1} AS (SELECT * FROM a{_n} UNION ALL SELECT * FROM b o WHERE number = {_k} AND coalesce({_OCR.format(f'a{_n}')}, true))"


@query(rf"""WITH {_BOXES}, {_OCR_STEPS}, g AS (SELECT doc_id, page, length(trim(string_agg(text, ' ' ORDER BY number))) >= 200 OR least(sum((x1 - x0) * (y1 - y0)) / (300 * 400), 1) >= 0.02 AS good FROM b WHERE number % 2 = 0 GROUP BY doc_id, page)
SELECT doc_id, page, CASE WHEN number % 2 = 0 THEN 'text' ELSE 'ocr' END AS source, number AS ix, text, x0, y0, x1, y1, CASE WHEN number % 2 = 1 THEN round(x0 / 200, 4) WHEN good THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence FROM a4 LEFT JOIN g USING (doc_id, page) WHERE number <> 9""")
def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even blocks as the text layer, odd ones as recognised, the last as a table."""
    boxes = _boxes(spark, sf_dir)
    ocr = boxes.where("number % 2 = 1 AND number < 9").withColumns({"ix": F.col("number"), "confidence": F.col("x0") / 200})
    return layout.merge_ocr(boxes.where("number % 2 = 0"), ocr, boxes.where("number = 9"), _sheets(boxes))


@query(r"""WITH c AS (SELECT l_orderkey AS doc_id, (l_linenumber % 2)::INT AS page, l_suppkey % 3 AS row_ix, l_partkey % 4 AS cell_ix, CASE WHEN l_quantity > 25 THEN 'x' ELSE ' ' END AS t, CASE WHEN l_orderkey % 2 = 0 THEN 'text' ELSE 'lines' END AS s FROM lineitem),
r AS (SELECT doc_id, page, s, row_ix, count(*) AS n, count(*) FILTER (trim(t) <> '') AS f, count(DISTINCT cell_ix) AS w FROM c GROUP BY ALL),
t AS (SELECT doc_id, page, s, count(*) AS rows, max(w) AS cols, sum(f) AS filled, sum(n) AS cells, count(*) FILTER (f >= 0.75 * n) AS dense FROM r GROUP BY ALL)
SELECT doc_id, page, rows >= 2 AND cols >= 2 AND filled >= 4 AND filled >= 0.5 * cells AND (s <> 'text' OR (dense >= 2 AND dense >= 0.75 * rows)) AS accepted FROM t""")
def table_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    cells = i.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).cast("int").alias("page"), F.lit(0).alias("number"), (F.col("l_suppkey") % 3).alias("row_ix"), (F.col("l_partkey") % 4).alias("cell_ix"), F.when(F.col("l_quantity") > 25, "x").otherwise(" ").alias("text"), F.when(F.col("l_orderkey") % 2 == 0, "text").otherwise("lines").alias("strategy"))
    return layout.accept_tables(cells).drop("number")


@query(r"""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, 8 + (l_partkey % 9)::DOUBLE AS size, l_suppkey % 4 = 0 AS bold, repeat('x', (l_quantity * 4)::INT) AS text FROM lineitem),
b AS (SELECT doc_id, list_sort(list(size)) AS s FROM p GROUP BY doc_id), q AS (SELECT p.*, s[len(s) // 2 + 1] AS base FROM p JOIN b USING (doc_id)),
h AS (SELECT *, size >= base + 1.5 OR (bold AND length(text) <= 90) AS is_h FROM q), r AS (SELECT doc_id, min(size) AS lo, max(size) AS hi FROM h WHERE is_h GROUP BY doc_id)
SELECT doc_id, n, CASE WHEN NOT is_h THEN 0 WHEN hi > lo THEN CASE WHEN (size - lo) / (hi - lo) >= 0.66 THEN 1 WHEN (size - lo) / (hi - lo) >= 0.33 THEN 2 ELSE 3 END WHEN size - base >= 6 THEN 1 WHEN size - base >= 3 THEN 2 ELSE 3 END AS level FROM h LEFT JOIN r USING (doc_id)""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    p = i.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), (8 + F.col("l_partkey") % 9).cast("double").alias("size"), (F.col("l_suppkey") % 4 == 0).alias("bold"), F.repeat(F.lit("x"), (F.col("l_quantity") * 4).cast("int")).alias("text"))
    return layout.infer_headings(p).select("doc_id", "n", "level")


@query(r"""WITH f AS (SELECT p_partkey AS usage_id, p_brand AS family, p_size % 2 = 0 AS bold, p_size % 3 = 0 AS italic, [65, 66, 65 + p_size % 30] AS chars FROM part),
faces AS (SELECT 'Brand#' || i AS family, '/f/' || i || '-' || j || '.ttf' AS path, 300 + j * 200 AS weight, j % 2 = 1 AS italic, 3 + i % 5 AS width, 60 + i AS last, 'brand' || i AS key FROM range(1, 20) a(i), range(3) b(j)),
p AS (SELECT usage_id, f.family, faces.family AS ff, path, faces.family = f.family AS exact, key, len(list_filter(list_distinct(chars), lambda c: c > last)) AS missing,
  round(abs(weight - CASE WHEN bold THEN 700 ELSE 400 END) / 500 + abs(width - 5) / 8 + CASE WHEN f.italic <> faces.italic THEN 0.35 ELSE 0 END + least(2.0, len(list_filter(list_distinct(chars), lambda c: c > last)) / len(list_distinct(chars))), 9) AS distance
  FROM f JOIN faces ON faces.family = f.family OR NOT EXISTS (SELECT 1 FROM faces x WHERE x.family = f.family))
SELECT usage_id, ff AS face_family, path AS face_path, exact, distance, missing::INT AS n_missing FROM (SELECT *, row_number() OVER (PARTITION BY usage_id ORDER BY distance, key, lower(path)) AS r FROM p) WHERE r = 1""")
def font_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    usages = p.select(F.col("p_partkey").alias("usage_id"), F.col("p_brand").alias("family"), (F.col("p_size") % 2 == 0).alias("bold"), (F.col("p_size") % 3 == 0).alias("italic"), F.array(F.lit(65), F.lit(66), 65 + F.col("p_size") % 30).alias("characters"))
    faces = spark.range(1, 20).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    faces = faces.select(F.concat(F.lit("Brand#"), F.col("i").cast("string")).alias("family"), F.concat(F.lit("/f/"), "i", F.lit("-"), "j", F.lit(".ttf")).alias("path"), (300 + F.col("j") * 200).alias("weight"), (F.col("j") % 2 == 1).alias("italic"), (3 + F.col("i") % 5).alias("width_class"), F.sequence(F.lit(0), (60 + F.col("i")).cast("int")).alias("glyphs"))
    return fonts.resolve_fonts(usages, faces).select("usage_id", "face_family", "face_path", "exact", "distance", "n_missing")


# ---------------------------------------------------------------- graphs


@query(r"""WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS src, (c_custkey * 7 + 3) % 1500 AS dst FROM customer WHERE c_custkey % 3 <> 0 UNION SELECT c_custkey, (c_custkey * 5 + 11) % 1500 FROM customer WHERE c_custkey % 4 = 0),
r(node, depth) AS (SELECT 1, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 40)
SELECT node::BIGINT AS node, min(depth)::INT AS depth FROM r GROUP BY node""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    a = c.where("k % 3 <> 0").select(F.col("k").alias("src"), ((F.col("k") * 7 + 3) % 1500).alias("dst"))
    b = c.where("k % 4 = 0").select(F.col("k").alias("src"), ((F.col("k") * 5 + 11) % 1500).alias("dst"))
    return graph.reachable(a.unionByName(b), spark.createDataFrame([(1,)], "node long"))


@query(r"""WITH RECURSIVE s AS (SELECT p_partkey // 50 AS doc_id, p_partkey % 50 AS id, CASE WHEN p_partkey % 50 > 0 THEN (p_partkey % 50) // 3 END AS base, CASE WHEN p_size % 3 = 0 THEN p_brand END AS family, CASE WHEN p_size % 4 = 0 THEN p_size::DOUBLE END AS size FROM part),
c(doc_id, node, anc, depth) AS (SELECT doc_id, id, id, 0 FROM s UNION ALL SELECT c.doc_id, c.node, s.base, c.depth + 1 FROM c JOIN s ON s.doc_id = c.doc_id AND s.id = c.anc WHERE s.base IS NOT NULL)
SELECT c.doc_id, c.node, arg_min(family, depth) FILTER (family IS NOT NULL) AS family, arg_min(size, depth) FILTER (size IS NOT NULL) AS size FROM c JOIN s ON s.doc_id = c.doc_id AND s.id = c.anc GROUP BY c.doc_id, c.node""")
def inheritance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select((k / 50).cast("long").alias("doc_id"), (k % 50).alias("style"), F.when(k % 50 > 0, ((k % 50) / 3).cast("long")).alias("base"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("family"), F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("double")).alias("size"))
    return graph.inherited(s, "style", "base", ["doc_id"], ["family", "size"])


@query(r"""WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey <> o_custkey), u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION (SELECT u.b, min(r.label) FROM r JOIN u ON u.a = r.node JOIN recurring.r AS old ON old.node = u.b WHERE r.label < old.label GROUP BY u.b))
SELECT node, label AS component FROM r""")
def connected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    return connected_components(spark, e)


@query(r"""WITH RECURSIVE p AS (SELECT p_partkey // 20 AS pkg_id, '/part' || p_partkey % 20 || '.xml' AS name, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'application/xml' END AS ct FROM part),
r AS (SELECT pkg_id, CASE WHEN k = 0 THEN '/' ELSE '/part' || k || '.xml' END AS owner, '/part' || ((k * 2 + pkg_id) % 23) || '.xml' AS target FROM (SELECT DISTINCT pkg_id FROM p), range(12) t(k)),
f AS (SELECT pkg_id, 'missing-content-type' AS code, name AS subject FROM p WHERE ct = '' UNION ALL
  SELECT pkg_id, 'missing-owner', owner || '#r' FROM r WHERE owner <> '/' AND NOT EXISTS (SELECT 1 FROM p WHERE p.pkg_id = r.pkg_id AND p.name = r.owner) UNION ALL
  SELECT pkg_id, 'missing-target', owner || '#r' FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pkg_id = r.pkg_id AND p.name = r.target)),
m(pkg_id, node) AS (SELECT DISTINCT pkg_id, '/' FROM p UNION SELECT m.pkg_id, r.target FROM m JOIN r ON r.pkg_id = m.pkg_id AND r.owner = m.node)
SELECT * FROM f UNION ALL
SELECT pkg_id, CASE WHEN pkg_id IN (SELECT pkg_id FROM f) THEN 'unreached' ELSE 'unreachable' END, name FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pkg_id = p.pkg_id AND m.node = p.name)""")
def package_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over packages made of the parts."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select((k / 20).cast("long").alias("pkg_id"), F.concat(F.lit("/part"), (k % 20).cast("string"), F.lit(".xml")).alias("name"), F.when(k % 13 == 0, "").otherwise("application/xml").alias("content_type"))
    name = lambda n: F.concat(F.lit("/part"), n.cast("string"), F.lit(".xml"))
    rel = parts.select("pkg_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).select("pkg_id", F.when(F.col("k") == 0, "/").otherwise(name(F.col("k"))).alias("owner"), F.lit("r").alias("id"), F.lit("t").alias("type"), name((F.col("k") * 2 + F.col("pkg_id")) % 23).alias("target"), F.lit("Internal").alias("mode"))
    return graph.audit_package(parts, rel)


# ---------------------------------------------------------------- colors


@query(r"""SELECT p_partkey, round(('0x' || substr(h, 1, 2))::INT / 255.0, 6) AS r, round(('0x' || substr(h, 3, 2))::INT / 255.0, 6) AS g, round(('0x' || substr(h, 5, 2))::INT / 255.0, 6) AS b, '#' || h AS back FROM (SELECT p_partkey, substr(md5(p_name || p_partkey), 1, 6) AS h FROM part)""")
def color_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat(F.lit("#"), F.substring(F.md5(F.concat("p_name", "p_partkey").cast("binary")), 1, 6))
    p = table(spark, sf_dir, "part").select("p_partkey", color.parse_color(c).alias("c"))
    return p.select("p_partkey", *[F.round(F.col("c")[n], 6).alias(n) for n in "rgb"], color.to_hex(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("back"))


@query(r"""SELECT p_partkey, round(s, 9) AS normal, round(b * s, 9) AS multiply, round(b + s - b * s, 9) AS screen, round(least(b, s), 9) AS darken, round(greatest(b, s), 9) AS lighten, round(abs(b - s), 9) AS difference, round(b + s - 2 * b * s, 9) AS exclusion,
  round(CASE WHEN b <= 0.5 THEN s * 2 * b ELSE s + (2 * b - 1) - s * (2 * b - 1) END, 9) AS overlay, round(CASE WHEN s <= 0.5 THEN b * 2 * s ELSE b + (2 * s - 1) - b * (2 * s - 1) END, 9) AS hard_light,
  round(CASE WHEN b = 0 THEN 0 WHEN s >= 1 THEN 1 ELSE least(1, b / (1 - s)) END, 9) AS color_dodge, round(CASE WHEN b >= 1 THEN 1 WHEN s <= 0 THEN 0 ELSE 1 - least(1, (1 - b) / s) END, 9) AS color_burn,
  round(CASE WHEN s <= 0.5 THEN b - (1 - 2 * s) * b * (1 - b) ELSE b + (2 * s - 1) * (CASE WHEN b <= 0.25 THEN ((16 * b - 12) * b + 4) * b ELSE sqrt(b) END - b) END, 9) AS soft_light
FROM (SELECT p_partkey, (p_partkey % 101)::DOUBLE / 100 AS b, (p_size * 7 % 101)::DOUBLE / 100 AS s FROM part)""")
def blend_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 101 / 100.0).alias("b"), (F.col("p_size") * 7 % 101 / 100.0).alias("s"))
    return p.select("p_partkey", *[F.round(color.blend(F.lit(m), F.col("b"), F.col("s")), 9).alias(m.replace("-", "_")) for m in color.BLEND_MODES])


# ---------------------------------------------------------------- tables, packages, mappings


@query(r"""WITH c AS (SELECT l_orderkey AS t, l_suppkey % 3 AS grid_col, l_linenumber AS row_ix, CASE WHEN l_partkey % 3 = 0 THEN 'continue' ELSE 'restart' END AS merge FROM lineitem),
s AS (SELECT *, sum(CASE WHEN merge <> 'continue' OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t, grid_col ORDER BY row_ix) AS run FROM (SELECT *, row_number() OVER (PARTITION BY t, grid_col ORDER BY row_ix) AS n FROM c))
SELECT t, grid_col, min(row_ix)::INT AS row_ix, count(*)::INT AS row_span FROM s GROUP BY t, grid_col, run""")
def vertical_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    cells = i.select(F.col("l_orderkey").alias("t"), (F.col("l_suppkey") % 3).alias("grid_col"), F.col("l_linenumber").alias("row_ix"), F.when(F.col("l_partkey") % 3 == 0, "continue").otherwise("restart").alias("merge"))
    return tables.merge_down(cells, ["t"])


@query(r"""SELECT l_orderkey AS t, string_agg(l_linenumber || ':' || l_returnflag || ' | ' || l_linestatus, chr(10) ORDER BY l_linenumber) AS text FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey""")
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("b"))
    i = one.select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("row_ix"), F.concat_ws(":", F.col("l_linenumber").cast("string"), "f").alias("a"), "b")
    cells = i.select("t", "row_ix", F.posexplode(F.array("a", "b")).alias("cell_ix", "text"))
    return tables.table_text(cells, ["t"])


@query(r"""WITH RECURSIVE c AS (SELECT l_orderkey AS t, l_linenumber // 2 AS r, l_linenumber % 2 AS k, 1 + min(l_partkey) % 3 AS rs, 1 + min(l_suppkey) % 2 AS cs, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
s(t, n, r, k, rs, cs, g, held) AS (SELECT t, n, r, k, rs, cs, 0::BIGINT, list_transform(range(0, cs), lambda i: {'c': i, 'u': r + rs}) FROM c WHERE n = 1 UNION ALL
  SELECT t, n, r, k, rs, cs, g, list_concat(held, list_transform(range(g, g + cs), lambda i: {'c': i, 'u': r + rs})) FROM (
    SELECT c.*, s.held, list_min(list_filter(range(0, 40), lambda x: x >= (CASE WHEN c.r = s.r THEN s.g + s.cs ELSE 0 END) AND len(list_filter(s.held, lambda h: h.u > c.r AND h.c >= x AND h.c < x + c.cs)) = 0)) AS g FROM s JOIN c ON c.t = s.t AND c.n = s.n + 1))
SELECT t, r::INT AS row_ix, k::INT AS cell_ix, rs::INT AS row_span, cs::INT AS col_span, g::INT AS grid_col FROM s""")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    n = F.col("l_linenumber")
    cells = i.select(F.col("l_orderkey").alias("t"), (n / 2).cast("int").alias("row_ix"), (n % 2).cast("int").alias("cell_ix"), (1 + F.col("p") % 3).cast("int").alias("row_span"), (1 + F.col("s") % 2).cast("int").alias("col_span"))
    return tables.place_cells(cells, ["t"])


@query(r"""WITH c AS (SELECT p_partkey AS id, p_partkey // 10 AS t, CASE WHEN p_size % 2 = 0 THEN p_brand END AS "top", CASE WHEN p_size % 3 = 0 THEN p_type END AS "left" FROM part),
b AS (SELECT t, 'T' || t AS "top", CASE WHEN t % 2 = 0 THEN 'L' || t END AS "left" FROM (SELECT DISTINCT p_partkey // 10 AS t FROM part) WHERE t % 5 <> 0)
SELECT c.id, c.t, coalesce(c."top", b."top") AS "top", coalesce(c."left", b."left") AS "left" FROM c LEFT JOIN b ON b.t = c.t""")
def merged_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    p = table(spark, sf_dir, "part").withColumn("t", (F.col("p_partkey") / 10).cast("long"))
    cells = p.select(F.col("p_partkey").alias("id"), "t", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("top"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("left"), none.alias("bottom"), none.alias("right"))
    name = lambda a: F.concat(F.lit(a), F.col("t").cast("string"))
    borders = p.select("t").distinct().where("t % 5 <> 0").select("t", name("T").alias("top"), F.when(F.col("t") % 2 == 0, name("L")).alias("left"), none.alias("bottom"), none.alias("right"))
    return tables.merge_borders(cells, borders, ["t"]).select("id", "t", "top", "left")


def _package(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("/p"), n.cast("string"))
    parts = table(spark, sf_dir, "part").select((k / 20).cast("long").alias("pkg_id"), name(k % 20).alias("name"))
    rel = parts.select("pkg_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(17))))
    rel = rel.select("pkg_id", F.when(F.col("k") < 3, "/").otherwise(name(F.col("k"))).alias("owner"), F.when((F.col("k") + F.col("pkg_id")) % 3 == 0, "style").otherwise("image").alias("type"), name((F.col("k") * 2 + F.col("pkg_id")) % 20).alias("target"), F.when(F.col("k") % 7 == 6, "External").otherwise("Internal").alias("mode"))
    return parts, rel


_PACKAGE = """rel AS (SELECT pkg_id, CASE WHEN k < 3 THEN '/' ELSE '/p' || k END AS owner, CASE WHEN (k + pkg_id) % 3 = 0 THEN 'style' ELSE 'image' END AS type, '/p' || ((k * 2 + pkg_id) % 20) AS target, k % 7 <> 6 AS inner_ FROM (SELECT DISTINCT p_partkey // 20 AS pkg_id FROM part), range(18) t(k))"""


@query(rf"""WITH RECURSIVE {_PACKAGE}, r(pkg_id, node, depth) AS (SELECT pkg_id, target, 0 FROM rel WHERE owner = '/' AND inner_ UNION SELECT r.pkg_id, rel.target, r.depth + 1 FROM r JOIN rel ON rel.pkg_id = r.pkg_id AND rel.owner = r.node AND rel.type = 'image' AND inner_ WHERE r.depth < 25)
SELECT pkg_id, node, min(depth)::INT AS depth FROM r GROUP BY pkg_id, node""")
def package_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, rel = _package(spark, sf_dir)
    return graph.package_closure(parts, rel, ["style", "image"], ["image"])


@query(rf"""WITH RECURSIVE {_PACKAGE}, seed AS (SELECT p_partkey // 20 AS pkg_id, '/p' || p_partkey % 20 AS node FROM part WHERE p_partkey % 20 >= 15),
r(pkg_id, node) AS (SELECT * FROM seed UNION SELECT r.pkg_id, rel.target FROM r JOIN rel ON rel.pkg_id = r.pkg_id AND rel.owner = r.node AND inner_) SELECT DISTINCT pkg_id, node AS name FROM r""")
def orphan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, rel = _package(spark, sf_dir)
    loaded = parts.where(F.substring("name", 3, 9).cast("int") < 15)
    return graph.orphan_parts(parts, loaded, rel)


@query(r"""SELECT least(min(o_orderkey), min(-2 * o_custkey - 1), min(-2 * o_orderkey - 2)) AS group_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS sources, least(min(o_orderkey % 5 + 1), 5)::INT AS rank
FROM orders GROUP BY o_custkey""")
def mapping_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    states = F.array(*map(F.lit, graph.STATES))
    # keys of the middle and last layer are negative, odd and even: no two layers share a node
    middle, last = -2 * F.col("o_custkey") - 1, -2 * F.col("o_orderkey") - 2
    a = o.select(F.col("o_orderkey").alias("source"), middle.alias("target"), F.element_at(states, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("state"))
    b = o.select(middle.alias("source"), last.alias("target"), F.lit("SEMANTIC").alias("state"))
    out = graph.compose_mappings(a, b)
    joined = F.array_join(F.array_sort(F.transform("sources", lambda x: x.cast("string"))), ",")
    return out.select("group_id", F.when(F.size("sources") > 0, joined).alias("sources"), graph.state_rank(F.col("state")).cast("int").alias("rank"))


@query(r"""WITH RECURSIVE s AS (SELECT p_partkey // 50 AS doc_id, p_partkey % 50 AS id, CASE WHEN p_partkey % 50 > 0 THEN (p_partkey % 50) // 3 END AS base, CASE WHEN p_size % 4 = 0 THEN p_size END AS v, p_size % 7 = 0 AS bad FROM part),
c(doc_id, node, anc, depth) AS (SELECT doc_id, id, id, 0 FROM s UNION ALL SELECT c.doc_id, c.node, s.base, c.depth + 1 FROM c JOIN s ON s.doc_id = c.doc_id AND s.id = c.anc WHERE s.base IS NOT NULL),
d AS (SELECT c.*, v, bad FROM c JOIN s ON s.doc_id = c.doc_id AND s.id = c.anc WHERE v IS NOT NULL OR bad), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, node ORDER BY depth) AS r FROM d)
SELECT s.doc_id, s.id AS node, CASE WHEN NOT coalesce(f.bad, false) THEN f.v END AS v FROM s LEFT JOIN f ON f.doc_id = s.doc_id AND f.node = s.id AND r = 1""")
def effective_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select((k / 50).cast("long").alias("doc_id"), (k % 50).alias("style"), F.when(k % 50 > 0, ((k % 50) / 3).cast("long")).alias("base"), F.when(F.col("p_size") % 4 == 0, F.col("p_size")).alias("v"), (F.col("p_size") % 7 == 0).alias("bad"))
    return graph.effective_or_unresolved(s, "style", "base", ["doc_id"], "v", "bad")


@query(r"""WITH RECURSIVE n AS (SELECT 0 AS doc_id, c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey * 3 + 25) % 1500 END AS up FROM customer), k AS (SELECT n.doc_id, n.id, n.up FROM n),
root AS (SELECT doc_id, id FROM k WHERE NOT EXISTS (SELECT 1 FROM k p WHERE p.doc_id = k.doc_id AND p.id = k.up)), r(doc_id, id) AS (SELECT * FROM root UNION SELECT k.doc_id, k.id FROM r JOIN k ON k.doc_id = r.doc_id AND k.up = r.id)
SELECT doc_id::INT AS doc_id, id AS node FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = k.doc_id AND r.id = k.id)""")
def cyclic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(F.lit(0).alias("doc_id"), k.alias("id"), F.when(k % 9 != 0, (k * 3 + 25) % 1500).alias("up"))
    return graph.cyclic_nodes(nodes, "id", "up", ["doc_id"])


# ---------------------------------------------------------------- more geometry, fonts, text


@query(r"""SELECT p_partkey, round(least(-y0, -y1) + 100, 6) AS x0, round(least(2 * x0, 2 * x1) + 5, 6) AS y0, round(greatest(-y0, -y1) + 100, 6) AS x1, round(greatest(2 * x0, 2 * x1) + 5, 6) AS y1
FROM (SELECT p_partkey, (p_partkey * 37 % 200)::DOUBLE AS x0, (p_partkey * 53 % 360)::DOUBLE AS y0, (p_partkey * 37 % 200 + 40)::DOUBLE AS x1, (p_partkey * 53 % 360 + 8)::DOUBLE AS y1 FROM part)""")
def matrix_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes turned by a quarter, stretched, and moved: two matrices composed."""
    k = F.col("p_partkey")
    x, y = (k * 37 % 200).cast("double"), (k * 53 % 360).cast("double")
    turn = geometry.Matrix(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 0.0, 0.0)))
    move = geometry.Matrix(*map(F.lit, (1.0, 0.0, 0.0, 2.0, 100.0, 5.0)))
    b = turn.then(move).bounds(geometry.Box(x, y, x + 40, y + 8))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(v, 6).alias(n) for n, v in zip(geometry.Box._fields, b, strict=True)])


@query(r"""SELECT p_partkey, CASE WHEN k = 0 THEN 'pt' WHEN k = 1 THEN 'ratio' WHEN k = 2 THEN 'auto' ELSE 'nil' END AS unit, CASE WHEN k = 0 THEN p_size / 20.0 WHEN k = 1 THEN p_size / 5000.0 END AS value FROM (SELECT *, p_partkey % 4 AS k FROM part)""")
def native_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "dxa").when(k == 1, "pct").when(k == 2, "auto").otherwise("nil")
    w = geometry.native_width(kind, F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", w["unit"].alias("unit"), w["value"].alias("value"))


@query(rf"""WITH {_BOXES}, s AS (SELECT *, lag(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, y1) AS before FROM b)
SELECT doc_id, page, number, sum(CASE WHEN y0 - before > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, y1)::BIGINT AS stack FROM s""")
def touching_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.touching_stacks(_boxes(spark, sf_dir), ["doc_id", "page"], gap=20.0).select("doc_id", "page", "number", "stack")


@query(rf"""WITH {_BOXES}, g AS (SELECT doc_id, page, y1 - y0 AS h, lead(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, y1) - y1 AS gap FROM b)
SELECT doc_id, page, coalesce(max(gap), 0) <= greatest(36, 2.5 * median(greatest(h, 1))) AS regular FROM g GROUP BY doc_id, page""")
def row_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.regular_row_spacing(_boxes(spark, sf_dir).withColumn("number", F.lit(0))).drop("number")


@query(r"""WITH s AS (SELECT p_partkey // 10 AS doc_id, (p_partkey % 2)::INT AS page, CASE WHEN p_size % 2 = 0 THEN 'h' ELSE 'v' END AS axis, (p_partkey * 7 % 5)::DOUBLE AS pl, (p_partkey * 11 % 40)::DOUBLE AS s0, (p_partkey * 11 % 40 + 30)::DOUBLE AS s1, p_type AS style FROM part),
d AS (SELECT doc_id, page, axis, k::DOUBLE AS pl, axis || k AS side_id, 20.0 AS a, 40.0 AS b FROM (SELECT DISTINCT doc_id, page FROM s), (VALUES ('h'), ('v')) x(axis), range(5) t(k)),
m AS (SELECT d.*, s0, s1, style, greatest(coalesce(max(s1) OVER (PARTITION BY d.doc_id, d.page, side_id ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a), a) AS reach FROM d JOIN s ON s.doc_id = d.doc_id AND s.page = d.page AND s.axis = d.axis AND s.pl = d.pl AND s0 < b AND s1 > a)
SELECT doc_id, page, side_id, min(style) AS style FROM m GROUP BY doc_id, page, side_id HAVING count(DISTINCT style) = 1 AND sum(greatest(least(s0, b) - reach, 0)) + greatest(max(b) - max(s1), 0) <= 0.0001""")
def stroke_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select((k / 10).cast("long").alias("doc_id"), (k % 2).cast("int").alias("page"), F.when(F.col("p_size") % 2 == 0, "h").otherwise("v").alias("axis"), (k * 7 % 5).cast("double").alias("at"), (k * 11 % 40).cast("double").alias("start"), (k * 11 % 40 + 30).cast("double").alias("end"), F.col("p_type").alias("style"))
    d = s.select("doc_id", "page").distinct().withColumn("axis", F.explode(F.array(F.lit("h"), F.lit("v")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    d = d.select("doc_id", "page", "axis", F.col("i").cast("double").alias("at"), F.concat("axis", F.col("i").cast("string")).alias("side_id"), F.lit(20.0).alias("start"), F.lit(40.0).alias("end"))
    return layout.match_strokes(s, d)


@query(r"""SELECT p_brand AS family, p_type AS kind, string_agg(DISTINCT c, '' ORDER BY c) AS characters FROM (SELECT p_brand, p_type, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY p_brand, p_type""")
def characters_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_type").alias("kind"), F.col("p_name").alias("text"))
    return pages.characters_used(runs, ["family", "kind"])


@query(r"""SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS key, regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9_]', '_', 'g') AS safe, replace(replace(p_name || '<' || p_brand || '>', '<', '&lt;'), '>', '&gt;') AS html, 'b' || substr(sha256(p_name), 1, 20) AS bookmark FROM part""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.font_family_key(brand).alias("key"), text.safe_id(F.concat_ws(" ", name, brand)).alias("safe"), text.escape_html(F.concat(name, F.lit("<"), brand, F.lit(">"))).alias("html"), text.bookmark_name(name).alias("bookmark"))


@query(r"""WITH i AS (SELECT page_id, ['ERROR', 'LOSS', 'WARNING', 'INFO'][page_id % 4 + 1] AS severity FROM pages WHERE page_id % 3 <> 0) SELECT p.page_id, NOT EXISTS (SELECT 1 FROM i WHERE i.page_id = p.page_id AND severity <> 'INFO') AS lossless FROM pages p""")
def lossless_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id")
    issues = p.where("page_id % 3 <> 0").withColumn("severity", F.element_at(F.array(*map(F.lit, pages.SEVERITIES)), (F.col("page_id") % 4 + 1).cast("int")))
    return pages.lossless(issues, p, "page_id")


@query(r"""SELECT o_orderpriority AS chart, string_agg(series, '; ' ORDER BY o_orderstatus) AS description FROM (
  SELECT o_orderpriority, o_orderstatus, o_orderstatus || ': ' || string_agg(y || ' ' || n, ', ' ORDER BY y) AS series FROM (SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority, o_orderstatus) GROUP BY o_orderpriority""")
def chart_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    points = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("chart"), F.col("o_orderstatus").alias("series_ix"), y.alias("idx")).agg(F.count("*").alias("value"))
    points = points.withColumns({"series_name": F.col("series_ix"), "category": F.col("idx").cast("string")})
    return charts.describe_chart(points, ["chart"])


# ---------------------------------------------------------------- files made of the documents


@query(r"""SELECT doc_id, sha256(replace(text, chr(13), '')) AS text_hash, CASE WHEN doc_id % 3 = 0 THEN 'utf-16-le' ELSE 'utf-8' END AS encoding, doc_id % 3 = 0 AS bom FROM documents""")
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded in two ways and read back by detection."""
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    content = F.when(F.col("doc_id") % 3 == 0, wide).otherwise(F.encode("text", "UTF-8"))
    d = table(spark, sf_dir, "documents").select("doc_id", decode_text(content).alias("d"))
    return d.select("doc_id", F.sha2("d.text", 256).alias("text_hash"), "d.encoding", "d.bom")


@query(r"""SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0""")
def html_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as HTML and read again without a loss: their lengths."""
    docs = table(spark, sf_dir, "documents").where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    blocks = lines.withColumns({"level": F.lit(0), "list_level": F.lit(None).cast("int"), "lang": F.lit(None).cast("string")})
    faults = sinks.verify_html(sinks.to_html(blocks, "doc_id"), "doc_id", blocks)
    return docs.join(faults.where("fault IS NULL"), "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


_SQUEEZED = r"trim(regexp_replace(line, '[ \t\r\x0B\x0C\x1C-\x1F\x85\xA0]+', ' ', 'g'))"


@query(rf"""WITH l AS (SELECT doc_id, i - 1 AS p, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
s AS (SELECT doc_id, p, {_SQUEEZED} AS text, p // 5 AS chapter FROM l), t AS (SELECT doc_id, chapter, text AS title FROM s WHERE p % 5 = 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INT AS ix, chapter::INT AS chapter, nullif(title, '') AS title, (row_number() OVER (PARTITION BY doc_id, chapter ORDER BY p) - 1)::INT AS pos,
  CASE WHEN p % 5 = 0 THEN 'h1' ELSE 'p' END AS tag, (p % 5 = 0)::INT AS level, text FROM s JOIN t USING (doc_id, chapter) WHERE text <> ''""")
def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents published as EPUB and read back as chapters."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).withColumns({"level": F.when(F.col("pos") % 5 == 0, 1).otherwise(0), "list_level": F.lit(None).cast("int"), "lang": F.lit("en")})
    back = sinks.to_epub(lines, "doc_id").select("doc_id", read_epub(F.col("content")).alias("e"))
    return back.select("doc_id", F.posexplode("e.blocks").alias("ix", "b")).select("doc_id", "ix", "b.*")


@query(r"""WITH p AS (SELECT doc_id, ps[i] AS line, i FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\n[ \t]*\n\s*') AS ps FROM documents))),
s AS (SELECT doc_id, i, nfc_normalize(trim(regexp_replace(line, '[ \t\n]+', ' ', 'g'))) AS text FROM p)
SELECT doc_id, 0 AS pos, 'heading' AS kind, 1 AS level, lang AS text FROM documents UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT, 'paragraph', 0, text FROM s WHERE text <> ''""")
def tex_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as LaTeX sources, read back by the lexer and reader."""
    docs = table(spark, sf_dir, "documents")
    source = F.concat(F.lit("\\documentclass{article}\n\\begin{document}\n\\section{"), "lang", F.lit("}\n"), text.escape_latex(F.col("text")), F.lit("\n\\end{document}\n"))
    read = docs.select("doc_id", read_tex(source).alias("t"))
    return read.select("doc_id", F.explode("t.blocks").alias("b")).select("doc_id", "b.pos", "b.kind", "b.level", "b.text")
