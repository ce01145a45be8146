"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

1. ``language_id``: documents without a recognisable language go: those without a letter (null and empty
   texts too) and those whose best language has a posterior below one half. ``lang`` becomes the predicted one.
2. ``jaccard_join``: one document of each group of near duplicates stays (five words, 0.8).
3. ``personal_data``: every span found is masked by its kind; ``n_chars`` follows the text.
4. ``source_mixing``: documents are replicated or left out so that a source weighs the square root of its size.
5. ``sentencepiece``: token ids and their number, with the document's id, language and source.

Stages 1 to 4 return the columns of ``documents``. Every stage works on all rows of the one before, reads
whole texts, takes null in any column, leaves columns that it doesn't name out of its result, and gives no
rows for an empty table. Sessions keep their settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.jaccard_join import keep_one_of_each
from quire.llm.language_id import UNKNOWN, fit, identify
from quire.llm.mixing import mix_sources
from quire.llm.pii import find_personal_data_in_rows
from quire.llm.queries import tokenizer_path
from quire.llm.sentencepiece_codec import encode_documents, load_model
from quire.plans.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_POSTERIOR = 0.5
#: Words that an encoder remembers: stages share the executors' memory with what Spark keeps of the earlier ones.
ENCODER_MEMORY = 50_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with it as ``lang``. Null and empty texts and those without a
    letter go, and those whose best posterior is below LEAST_POSTERIOR. Learns from the rows with a ``lang``
    that aren't held out; without one, nothing is recognised. Repeated rows are judged alike."""
    name, score = identify(docs, fit(docs))
    found = F.struct(name.alias("lang"), score.alias("score"))
    # kept rows come out of a generator: a filter on them would be pushed down, and classify a second time
    sure = F.filter(F.array(found), lambda x: (x["lang"] != UNKNOWN) & (x["score"] >= LEAST_POSTERIOR))
    judged = docs.drop("lang").select("*", F.explode(sure).alias("_language"))
    return judged.withColumn("lang", F.col("_language.lang")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, then the smallest digest of its
    text, rows without an id last. Rows without words all stay; of rows equal in id and text, one does."""
    return keep_one_of_each(docs, k=5, percent=80).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every span of personal data masked by its kind, overlapping spans as one; ``n_chars``
    follows the text. A null text stays null, as does its ``n_chars``. Repeated rows are masked alike."""
    return find_personal_data_in_rows(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows replicated by a Poisson number with their source's rate, in a global shuffle; a number of 0 leaves a row
    out. A source weighs the square root of its rows, null sources are one source, and rows of one id (null
    too) are replicated alike."""
    return mix_sources(docs, temperature=0.5).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of every row. A null text has null ids and 0 tokens, an empty
    one no ids."""
    out = encode_documents(docs, load_model(tokenizer_path(), ENCODER_MEMORY))
    return out.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: A learned classifier, a graph search and a tokenizer: tested against brute force, not by SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows go through a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
