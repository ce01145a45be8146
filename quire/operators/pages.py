"""Relations over parsed HTML: blocks, links and their targets, text projections, boilerplate, loss ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import repeat_key
from quire.sources.html import html_table, read_html

#: Severities from the worst to the mildest.
SEVERITIES = ("ERROR", "LOSS", "WARNING", "INFO")


def blocks(docs: DataFrame, row_id: str, html: str = "html") -> DataFrame:
    return html_table(docs, "blocks", row_id, html)


def link_integrity(links: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """Add ``status`` to fragment links: ok with exactly one target (or ``#top`` without any), missing with
    none, ambiguous with more. Other links are left out. Targets are counted before the join."""
    inner = links.where(F.startswith("href", F.lit("#"))).withColumn("ids", F.substring("href", 2, 1 << 20))
    n = ids.groupBy(row_id, "ids").agg(F.count("*").alias("_n"))
    out = inner.join(n, [row_id, "ids"], "left")
    found = F.coalesce("_n", F.lit(0))
    status = F.when(found == 1, "ok").when((found == 0) & (F.lower("ids") == "top"), "ok").when(found == 0, "missing").otherwise("ambiguous")
    return out.select(row_id, "ix", "href", status.alias("status"))


def repeated_ids(ids: DataFrame, row_id: str) -> DataFrame:
    return ids.groupBy(row_id, "ids").agg(F.count("*").alias("n")).where("n > 1")


def unique_owners(ids: DataFrame, row_id: str) -> DataFrame:
    """(ids, owner) of ids that exactly one document has, once."""
    return ids.groupBy("ids").agg(F.count("*").alias("_n"), F.min(row_id).alias("owner")).where("_n = 1").drop("_n")


def boilerplate(rows: DataFrame, row_id: str, text: str = "text", share: float = 0.5, least: int = 2) -> DataFrame:
    """(key, n) of texts, numbers aside, that at least max(``least``, ``share`` of all) documents have. The
    number of documents is one count; keys are counted once a document before they are counted over all."""
    keyed = rows.withColumn("key", repeat_key(F.col(text))).where("key <> ''")
    total = rows.select(row_id).distinct().count()
    per = keyed.groupBy("key", row_id).agg(F.lit(1).alias("_o")).groupBy("key").agg(F.count("*").alias("n"))
    return per.where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.lit(share * total))))


def without_boilerplate(rows: DataFrame, repeated: DataFrame, text: str = "text") -> DataFrame:
    keyed = rows.withColumn("key", repeat_key(F.col(text)))
    return keyed.join(repeated.select("key"), "key", "left_anti").drop("key")


def plain_text(rows: DataFrame, row_id: str, order: str = "pos", text: str = "text", glue: str = "\n") -> DataFrame:
    """(row_id, plain): non-empty texts in order."""
    lines = F.sort_array(F.collect_list(F.when(F.col(text) != "", F.struct(order, text))))
    return rows.groupBy(row_id).agg(F.array_join(F.transform(lines, lambda s: s[text]), glue).alias("plain"))


def flat_projection(blocks: DataFrame, cells: DataFrame, row_id: str) -> DataFrame:
    """(row_id, plain): paragraphs that aren't empty, and tables as rows of cells joined by `` | ``, in order."""
    rows = cells.groupBy(row_id, "table_ix", "row_ix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_ix", "text"))), lambda c: c["text"]), " | ").alias("_r"))
    tables = rows.groupBy(row_id, "table_ix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_ix", "_r"))), lambda r: r["_r"]), "\n").alias("text"))
    first = blocks.where("table_ix IS NOT NULL").groupBy(row_id, "table_ix").agg(F.min("pos").alias("pos"))
    placed = tables.join(first, [row_id, "table_ix"], "left").select(row_id, F.coalesce("pos", F.lit(1 << 30)).alias("pos"), "text")
    both = blocks.where("table_ix IS NULL").select(row_id, "pos", "text").unionByName(placed)
    return plain_text(both, row_id)


def flat_pages(docs: DataFrame, row_id: str, html: str = "html") -> DataFrame:
    """(row_id, plain) of the flat projection, page by page where it is read: nothing is shuffled."""
    return docs.select(row_id, read_html(F.col(html), "flat")["flat"].alias("plain")).where("plain IS NOT NULL")


def tab_text(blocks: DataFrame, row_id: str) -> DataFrame:
    """(row_id, plain): all paragraphs, empty ones too, a line each."""
    lines = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return blocks.groupBy(row_id).agg(F.array_join(F.transform(lines, lambda s: s["text"]), "\n").alias("plain"))


def ledger(issues: DataFrame, row_id: str, assessed: list[str] | None = None) -> DataFrame:
    """(row_id, codes, n_issues, assessment_complete): distinct codes; complete where the codes recorded are
    among the assessed ones and all of these were assessed (never without an assessment)."""
    out = issues.groupBy(row_id).agg(F.array_sort(F.collect_set("code")).alias("codes"), F.count("*").alias("n_issues"))
    if assessed is None:
        return out.withColumn("assessment_complete", F.lit(False))
    return out.withColumn("assessment_complete", F.size(F.array_except("codes", F.array(*map(F.lit, assessed)))) == 0)


def union_issues(records: DataFrame, warnings: DataFrame, row_id: str) -> DataFrame:
    """(row_id, source, code, message, severity): preservation records with a state other than SEMANTIC
    (REJECTED is an error, the rest losses), then warnings that no record is linked to by path and message;
    exact repeats once."""
    severity = F.when(F.col("state") == "REJECTED", "ERROR").otherwise("LOSS")
    kept = records.where("state <> 'SEMANTIC'").select(row_id, F.lit("record").alias("source"), "code", "message", severity.alias("severity"))
    linked = records.where("path IS NOT NULL").select(row_id, "path", "message").distinct()
    free = warnings.join(linked, [row_id, "path", "message"], "left_anti").select(row_id, F.lit("warning").alias("source"), "code", "message", F.lit("WARNING").alias("severity"))
    return kept.unionByName(free).dropDuplicates()


def lossless(issues: DataFrame, docs: DataFrame, row_id: str) -> DataFrame:
    """(row_id, lossless): no error, loss or warning."""
    bad = issues.where(F.col("severity") != "INFO").select(row_id).distinct().withColumn("_b", F.lit(True))
    return docs.select(row_id).join(bad, row_id, "left").select(row_id, F.col("_b").isNull().alias("lossless"))


def toc(blocks: DataFrame, row_id: str) -> DataFrame:
    """(row_id, pos, level, text, parent_pos): headings under the nearest earlier heading of a lower level."""
    heads = blocks.where("level > 0").select(row_id, "pos", "level", "text")
    w = Window.partitionBy(row_id).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(w).alias(f"_p{k}") for k in range(1, 7)]
    wide = heads.select("*", *before)
    parent = F.lit(None).cast("int")
    for k in range(1, 6):
        # a lower level wins over what precedes it: the latest of all lower levels is the nearest
        parent = F.when(F.col("level") > k, F.greatest(*([F.coalesce(parent, F.lit(-1)), F.coalesce(f"_p{k}", F.lit(-1))]))).otherwise(parent)
    return wide.select(row_id, "pos", "level", "text", F.when(parent >= 0, parent).alias("parent_pos"))


def inspection(docs: DataFrame, row_id: str, html: str = "html") -> DataFrame:
    """(row_id, title, lang, one column per metric)."""
    found = docs.select(row_id, read_html(F.col(html), "title", "lang", "metrics").alias("_d"))
    names = ("sections", "headings", "paragraphs", "tables", "rows", "cells", "images", "internal_links", "hyperlinks", "formulas", "lists", "items", "characters", "text_runs")
    return found.select(row_id, "_d.title", "_d.lang", *[F.col("_d.metrics")[n].alias(f"n_{n}") for n in names])


def families(runs: DataFrame, row_id: str) -> DataFrame:
    """(row_id, family, n, place): font families with their place, from 1, by frequency, then first use."""
    found = runs.where("family IS NOT NULL").groupBy(row_id, "family").agg(F.count("*").alias("n"), F.min(F.struct("pos", "ix")).alias("_f"))
    place = F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc("n"), "_f"))
    return found.withColumn("place", place).drop("_f")


def characters_used(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, characters): distinct characters of each font usage, in order."""
    each = runs.select(*by, F.explode(F.array_distinct(F.split("text", ""))).alias("_c")).where("_c <> ''").distinct()
    return each.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("_c")), "").alias("characters"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
