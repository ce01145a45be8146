"""Quality rules judged by document, and by host with shrunken failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BLANKS, let
from quire.plans.scratch import Scratch

#: Fixed values of the rules.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30


def words(text: Column) -> Column:
    """Runs of code points other than 9 to 13 and the space."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window that occurs twice or more.

    Windows are hashed; only a text whose hashes aren't all distinct goes on. Its hashes are sorted with
    their places, so those with an equal neighbour are the repeated ones; the places of these, in order,
    cover ``least(window, distance)`` new words each. n log n in the words of the text, within its own row.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(F.slice(w, i + 1, window)))
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"), p.alias("last"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
    cover = lambda s: F.aggregate(F.sort_array(F.transform(twice(s), lambda x: x["p"])), start, step, lambda acc: acc["n"])
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed(h), cover)).otherwise(0)
    return let(tokens, lambda w: F.when(F.size(w) > window, let(hashes(w), some)).otherwise(0))


def features(docs: DataFrame, text: str = "text") -> dict[str, Column]:
    """The counts of a text; a null text counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bare = F.translate(t, BLANKS + " ", "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, BLANKS + " ", "") != "")
    counts = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "_c": counts,
        "_l": by_line,
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
    }


def judge_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", max_host_failure: float = 0.5, broadcast_hosts: int = 100_000, salts: int = 64) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, host_failure).

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. A document
    fails a rule for its host if it is base_failed, or over 10 % of its word characters are symbols, or
    over 30 % of its lines are duplicates. Failure rates of hosts are shrunk with a beta prior whose two
    parameters are fitted to all hosts by moments: (failures + a) / (documents + a + b). A host over
    ``max_host_failure`` is rejected with all its documents; ``kept`` is false for these and for documents
    that are base_failed. Null hosts are one host of their own. A null or empty text has no words and fails.
    Repeated rows are judged alike and each counts for its host; long texts are judged whole, within their
    row; an empty table gives no rows.

    Failures are aggregated per host before the shuffle. Verdicts return by a broadcast where the hosts
    are at most ``broadcast_hosts``, else by a join whose host keys are dealt over ``salts``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), *[c.alias(n) for n, c in features(docs, text).items()])
    rows = rows.select("doc_id", "host", "_c.n_words", "word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_c.n_repeat_words")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    rows = scratch.keep(rows.withColumn("base_failed", base).withColumn("rule_failed", F.col("base_failed") | more))
    hosts = scratch.keep(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("k")))
    rate = F.col("k") / F.col("n")
    n_hosts, mean, var = hosts.agg(F.count("*"), F.avg(rate), F.var_pop(rate)).first()
    a, b = beta_prior(mean or 0.0, var or 0.0)
    verdicts = hosts.select("host", ((F.col("k") + a) / (F.col("n") + (a + b))).alias("host_failure"))
    same = lambda d, v: d["host"].eqNullSafe(v["host"])
    if n_hosts <= broadcast_hosts:
        joined = rows.join(F.broadcast(verdicts), same(rows, verdicts), "left").drop(verdicts["host"])
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        spread = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = salted.join(spread, same(salted, spread) & (salted["salt"] == spread["salt"]), "left").drop(spread["host"], spread["salt"])
    kept = ~F.col("base_failed") & (F.col("host_failure") <= max_host_failure)
    return joined.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_failure")


def beta_prior(mean: float, var: float, strength: float = 20.0, least: float = 1e-3) -> tuple[float, float]:
    """(a, b) of the beta distribution with this mean and variance; where the variance says nothing
    (no spread, or more than a beta can have), the mean counts as ``strength`` documents."""
    mean = min(max(mean, least), 1 - least)
    size = mean * (1 - mean) / var - 1 if var > 0 else 0.0
    size = size if size > 0 else strength
    return mean * size, (1 - mean) * size
