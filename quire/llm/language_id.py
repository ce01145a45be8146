"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out

#: Odd multipliers of the rolling hash, fixed so that models stay valid.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
UNKNOWN = "und"
#: Characters that are worked on at a time.
PIECE = 250_000


def _grams(texts: list[str], orders: tuple[int, ...], bits: int, more: list[bool] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, starts) for each order over the joined framed texts; a gram that would leave its text gets
    the bucket ``2**bits``, which weighs nothing. Where ``more`` says so, a text is a piece whose last
    ``max(orders) - 1`` characters begin the next piece, and no gram starts in them."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))
    if more is not None:
        left[np.repeat(np.array(more), lengths) & (left < max(orders))] = 0
    code = np.zeros(len(points), np.uint64)
    for n in range(1, max(orders) + 1):
        shifted = np.zeros_like(points)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        code = (code + shifted + np.uint64(1)) * MIX[0]
        if n in orders:
            bucket = (((code ^ (code >> np.uint64(29))) * MIX[1]) >> np.uint64(64 - bits)).astype(np.int64)
            bucket[left < n] = 1 << bits
            yield bucket, ends - lengths


def _pieces(texts: list[str], orders: tuple[int, ...], most: int = PIECE) -> Iterator[tuple[list[str], list[bool], np.ndarray]]:
    """(pieces, whether a text goes on behind its piece, rows of the texts) in chunks of about ``most``
    characters. Texts are lower-cased and framed by a blank; a longer text is cut into overlapping pieces,
    so a chunk's arrays are bounded whatever a text's length."""
    own, more, rows, size, overlap = [], [], [], 0, max(orders) - 1
    for i, t in enumerate(texts):
        framed, at = f" {t.lower()} ", 0
        while True:
            goes_on = len(framed) - at > most + overlap
            piece = framed[at : at + most + overlap] if goes_on else framed[at:]
            if size and size + len(piece) > most:
                yield own, more, np.array(rows)
                own, more, rows, size = [], [], [], 0
            own.append(piece)
            more.append(goes_on)
            rows.append(i)
            size += len(piece)
            if not goes_on:
                break
            at += most
    if own:
        yield own, more, np.array(rows)


@dataclass
class NaiveBayes:
    """``weights``: languages x (2**bits + 1) log probabilities, the last of each 0."""

    langs: list[str]
    prior: np.ndarray
    weights: np.ndarray
    orders: tuple[int, ...]
    bits: int

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the likeliest language, its posterior) of each text."""
        total = np.repeat(self.prior[None, :], len(texts), 0)
        for own, more, rows in _pieces(texts, self.orders):
            for bucket, starts in _grams(own, self.orders, self.bits, more):
                for k in range(len(self.langs)):
                    np.add.at(total[:, k], rows, np.add.reduceat(self.weights[k][bucket], starts))
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0)
        return total.argmax(1), 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, alpha: float = 0.5, max_docs: int = 20_000, max_langs: int = 4_096, max_cells: int = 1 << 24) -> NaiveBayes | None:
    """Counts of hashed n-grams by language, over labelled rows that aren't held out. None without such a row.

    ``max_docs`` bounds the rows that the counts expect to read. It is shared out evenly: a language with
    fewer rows than its share is read whole, and of any other so many as its share, chosen by a hash of the
    id, so rare languages are learned from all they have. Priors come from all rows. Of more than
    ``max_langs`` labels the commonest are learned. ``max_cells`` bounds the matrix that the driver sums and
    broadcasts: ``bits`` give way to the number of languages. A language whose sample holds no gram is left
    out. Null texts and labels are no examples; repeated rows count as often as they are there.
    """
    label = F.col(lang).cast("string")
    known = docs.where(label.isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    per_lang = known.groupBy(label.alias("l")).count().orderBy(F.desc("count"), "l").limit(max_langs).collect()
    if not per_lang:
        return None
    langs, sizes = zip(*sorted((r["l"], r["count"]) for r in per_lang), strict=True)
    bits = min(bits, max(8, (max_cells // len(langs)).bit_length() - 1))
    share, rest = max_docs, len(langs)
    for n in sorted(sizes):  # what small languages leave of their shares goes to the others
        if n * rest > share:
            break
        share, rest = share - n, rest - 1
    each = share / rest if rest else max(sizes)
    limit = F.create_map(*[F.lit(x) for k, n in zip(langs, sizes, strict=True) for x in (k, int(min(1.0, each / n) * (1 << 30)))])
    sample = known.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)) < F.try_element_at(limit, label)).select(label.alias("l"), F.col(text).cast("string").alias("t"))
    at = {x: i for i, x in enumerate(langs)}
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            texts, by = batch["t"].to_pylist(), [at[x] for x in batch["l"].to_pylist()]
            for k in sorted(set(by)):
                mine = [t for t, i in zip(texts, by, strict=True) if i == k]
                own_sums = sums.setdefault(k, np.zeros(width + 1, np.int64))
                for own, more, _ in _pieces(mine, orders):
                    for bucket, _ in _grams(own, orders, bits, more):
                        own_sums += np.bincount(bucket, minlength=width + 1)
        for k, found in sums.items():
            g = np.flatnonzero(found[:width])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g, pa.int32()), pa.array(found[g])], ["k", "g", "n"])

    found = sample.mapInArrow(count, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), width))
    counts[found["k"].to_numpy(), found["g"].to_numpy()] = found["n"].to_numpy()
    seen = np.flatnonzero(counts.sum(1))
    if not len(seen):
        return None
    counts = counts[seen]
    logs = np.log(counts + alpha) - np.log(counts.sum(1, keepdims=True) + alpha * width)
    weights = np.concatenate([logs, np.zeros((len(seen), 1))], 1)
    prior = np.log(np.array(sizes)[seen] / sum(sizes))
    return NaiveBayes([langs[i] for i in seen], prior, weights, orders, bits)


def _scorer(shared):
    @F.arrow_udf("lang string, score double")
    def classify(texts: pa.Array, letters: pa.Array) -> pa.Array:
        model = shared.value
        rows = [t if has else None for t, has in zip(texts.to_pylist(), letters.to_pylist(), strict=True)]
        at = [i for i, t in enumerate(rows) if t is not None]
        lang, score = [UNKNOWN] * len(rows), np.zeros(len(rows))
        if at and model:
            best, sure = model.score([rows[i] for i in at])
            score[at] = sure
            for i, k in zip(at, best, strict=True):
                lang[i] = model.langs[k]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    return classify


def identify(docs: DataFrame, model: NaiveBayes | None, text: str = "text") -> tuple[Column, Column]:
    """(language, posterior from 0 to 1) of whole texts; ``und`` and 0 where a text is null or has no letter
    (Unicode category L), and everywhere without a model. The matrix is broadcast; ``fit`` bounds its cells."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    t = F.col(text).cast("string")
    found = _scorer(shared)(t, F.coalesce(t.rlike(r"\p{L}"), F.lit(False)))
    return found["lang"], found["score"]


def predict_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with ``held_out, lang_pred, score`` (columns of these names are replaced). Learns only from
    text and non-null ``lang`` of rows that aren't held out; repeated rows are judged alike, long texts whole.
    Without a row to learn from, every row is ``und``; an empty table gives no rows."""
    model = fit(docs, text, lang, doc_id, **settings)
    name, score = identify(docs, model, text)
    out = docs.withColumn("_found", F.struct(name.alias("lang"), score.alias("score")))
    return out.withColumns({"held_out": held_out(F.col(doc_id)), "lang_pred": F.col("_found.lang"), "score": F.col("_found.score")}).drop("_found")
