"""Personal data: exact base patterns, and a contextual extraction bootstrapped from them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch

#: Kinds in the order of the digest (fixed values), and their patterns.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # a match never begins inside a run: its start would do
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: What may be an identifier: a word that holds a digit or an at sign, plain or spelled; a word with a digit goes
#: on through further words of digits and their marks. With its frame off it has at least five digits or an at sign.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"([0-9().+/-]*[0-9][0-9().+/-]*)[,;:!?\"']*")
_AT = re.compile(r"@|[(\[{<](?:at|AT|At)[)\]}>]")
_FRAME = "\"'`()[]{}<>,;:!?.*#$%&|="
LEAST_DIGITS = 5
#: A longer word beside a mention is known by so many characters next to it, a longer surface by its digest.
LONGEST = 64

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + twice) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches. A match's local part is the whole run before its ``@``, and a run
    whose ``@`` fails can't match from a later start, so only the ``@`` signs are looked at."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            end = m.end()
            yield m.span()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; code points, end exclusive. Failing matches are dropped."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
    cards = ((m, re.sub("[ -]", "", m[0])) for m in _CARD.finditer(text))
    out += [("card", *m.span()) for m, d in cards if 13 <= len(d) <= 19 and _luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _surface(text: str) -> str:
    return text if len(text) <= LONGEST else "\x00" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


class _Words:
    """The words of a text, for the contexts of its spans."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def context(self, start: int, end: int) -> tuple[str, str]:
        """The two words before and the word after, lower-cased; what a span cuts off a word is a word. Empty
        where there are fewer."""
        i = bisect_left(self.starts, start)
        before = [self._end(a, min(b, start)) for a, b in self.spans[max(0, i - 2) : i]]
        j = bisect_right(self.starts, end - 1) - 1
        after = ""
        if j >= 0 and self.spans[j][1] > end:
            after = self._start(end, self.spans[j][1])
        elif j + 1 < len(self.spans):
            after = self._start(*self.spans[j + 1])
        return " ".join(before) if len(before) == 2 else "", after

    def _end(self, a: int, b: int) -> str:
        return self.text[a:b].lower() if b - a <= LONGEST else "\x00" + self.text[b - LONGEST : b].lower()

    def _start(self, a: int, b: int) -> str:
        return self.text[a:b].lower() if b - a <= LONGEST else self.text[a : a + LONGEST].lower() + "\x00"


def candidates(words: _Words, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of what may be an identifier and touches none of the sorted spans ``taken``."""
    text, i, free = words.text, 0, []
    for a, b in words.spans:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        free.append(i == len(taken) or taken[i][0] >= b)
    k = 0
    while k < len(words.spans):
        a, b = words.spans[k]
        k += 1
        if not free[k - 1]:
            continue
        if _DIGIT.search(text, a, b):
            while k < len(words.spans) and free[k] and text[b : words.spans[k][0]] == " " and (m := _DIGITS.fullmatch(text, *words.spans[k])):
                b = words.spans[k][1]
                k += 1
                if m.end(1) < b:  # a mark ends the run
                    break
        elif not _AT.search(text, a, b):
            continue
        whole, end = a, b
        while a < b and text[a] in _FRAME:
            a += 1
        while b > a and text[b - 1] in _FRAME:
            b -= 1
        if a > whole and text[a - 1] == "(" and ")" in text[a:b]:
            a -= 1
        if b < end and text[b] in ")" and "(" in text[a:b] and ")" not in text[a:b]:
            b += 1
        if sum(1 for _ in islice(_DIGIT.finditer(text, a, b), LEAST_DIGITS)) == LEAST_DIGITS or _AT.search(text, a, b):
            yield a, b


def mentions(text: str, spans: list[Span]) -> list[tuple[int, int, str | None, str, str, str]]:
    """(start, end, kind or None, surface, words before, word after) of base spans and of what else may be an
    identifier and doesn't touch a base span. Linear in the text, but for the sorting of its spans."""
    words = _Words(text)
    out = [(a, b, k, _surface(text[a:b]), *words.context(a, b)) for k, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    return out + [(a, b, None, _surface(text[a:b]), *words.context(a, b)) for a, b in candidates(words, taken)]


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


_MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surface", pa.string()), ("before", pa.string()), ("after", pa.string())])
_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:string,start:int,end:int>>, mentions array<struct<start:int,end:int,kind:string,surface:string,before:string,after:string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _find_batch(texts: pa.Array) -> pa.Array:
    counts, shas, spans, near = [], [], [], []
    for t in texts.to_pylist():
        found = base_spans(t or "")
        counts.append([sum(k == x for k, _, _ in found) for x in KINDS])
        shas.append(digest(found))
        spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
        near.append([dict(zip(("start", "end", "kind", "surface", "before", "after"), m, strict=True)) for m in mentions(t or "", found)])
    columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
    return pa.StructArray.from_arrays([*columns, pa.array(shas), pa.array(spans, pa.list_(_SPAN)), pa.array(near, pa.list_(_MENTION))], ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"])


def learn_patterns(mentioned: DataFrame, scratch: Scratch, min_seeds: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """(pattern, kind, confidence) of lexical patterns that find identifiers of a kind.

    ``mentioned``: rows (kind or null, surface, before, after). A pattern is the two words before a mention,
    or the word before and the word after. The graph has an edge from each pattern to each distinct surface
    in its context.

    In each round, a surface votes for a pattern and kind with 1 if it is a seed of the kind, and with 0 if
    it is one of another kind. Any other surface votes with the largest confidence of the *other* patterns
    of the kind that are accepted already and hold it; 0 without one, so an unknown surface counts against a
    pattern, and no pattern speaks for itself. A pattern's confidence is the sum of its votes over its
    surfaces plus one; it is accepted from ``min_confidence`` with ``min_seeds`` surfaces that vote for it.
    So what accepted patterns discover induces patterns that no seed has. Votes only grow, and rounds end
    when nothing new is accepted.

    The graph is aggregated to distinct edges before anything else. Patterns are scored by partial sums;
    votes go along edges by joins that Spark may split where a pattern or surface is hot, and only along
    those of surfaces that an accepted pattern holds.
    """
    last = F.element_at(F.split("before", " "), -1)
    shapes = F.array(F.when(F.col("before") != "", F.concat(F.lit("L:"), "before")), F.when((F.col("before") != "") & (F.col("after") != ""), F.concat(F.lit("B:"), last, F.lit(" _ "), "after")))
    edges = mentioned.select(F.explode(shapes).alias("pattern"), "surface", "kind").where("pattern IS NOT NULL")
    edges = scratch.keep(edges.groupBy("pattern", "surface").agg(F.max("kind").alias("kind")))
    seeds = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    seeds = scratch.keep(seeds.withColumn("seeds", F.col("seeds").cast("double")))
    sizes = scratch.keep(edges.groupBy("pattern").agg(F.count("*").alias("size")))
    unknown = scratch.keep(edges.where("kind IS NULL").select("pattern", "surface"))
    none = F.lit(0.0)

    def accepted(votes: DataFrame | None) -> DataFrame:
        """(pattern, kind, confidence) under the votes (pattern, kind, n, gain) of unknown surfaces."""
        found = seeds.withColumns({"n": F.col("seeds"), "gain": none})
        if votes is not None:
            both = seeds.join(votes, ["pattern", "kind"], "full")
            seeded = F.coalesce("seeds", none)
            found = both.select("pattern", "kind", seeded.alias("seeds"), (seeded + F.coalesce("n", none)).alias("n"), F.coalesce("gain", none).alias("gain"))
        found = found.where(F.col("n") >= min_seeds).join(sizes, "pattern")
        sure = (F.col("seeds") + F.col("gain")) / (F.col("size") + 1)
        return scratch.keep(found.select("pattern", "kind", sure.alias("confidence")).where(F.col("confidence") >= min_confidence))

    found = accepted(None)
    n = found.count()
    while n:
        # of each surface and kind, the surest pattern and the runner-up: a pattern hears the surest other one
        held = unknown.join(found, "pattern")
        top = held.groupBy("surface", "kind").agg(F.max(F.struct("confidence", "pattern")).alias("top"))
        rest = held.join(top, ["surface", "kind"]).where(F.col("pattern") != F.col("top.pattern")).groupBy("surface", "kind").agg(F.max("confidence").alias("second"))
        best = scratch.keep(top.join(rest, ["surface", "kind"], "left").select("surface", "kind", "top", "second"))
        vote = F.when(F.col("pattern") == F.col("top.pattern"), F.col("second")).otherwise(F.col("top.confidence"))
        votes = unknown.join(best, "surface").select("pattern", "kind", vote.alias("vote")).where("vote IS NOT NULL")
        grown = accepted(votes.groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("n"), F.sum("vote").alias("gain")))
        more = grown.count()
        scratch.drop(found, best)
        found = grown
        if more <= n:
            break
        n = more
    return found


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_broadcast: int = 50_000, keep: tuple[str, ...] = (), **settings) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, all_spans) and the columns ``keep``, for every row.

    The counts and the digest are those of the base spans; ``spans`` joins all spans as ``kind:start:end``
    by kind, then start, and ``all_spans`` holds them as an array. Added spans have a kind of the base and
    never overlap a base span. A null text is an empty one. Repeated rows are judged alike; long texts are
    read whole, in time linear in their length; an empty table gives no rows. Other columns are left out.

    Texts are read once; what goes on is the mentions. Patterns are broadcast where there are at most
    ``max_broadcast`` of them, else joined.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.arrow_udf(_find_batch, _FOUND)(F.col(text).cast("string")).alias("f"))
    rows = scratch.keep(rows.select("doc_id", *keep, "f.*").withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    patterns = scratch.keep(learn_patterns(each.select("kind", "surface", "before", "after"), scratch, **settings))
    n = patterns.count()
    base = F.col("base")
    if n == 0:
        spans = base
        out = rows
    else:
        last = F.element_at(F.split("before", " "), -1)
        free = each.where("kind IS NULL AND before <> ''").select("row", "start", "end", F.explode(F.array(F.concat(F.lit("L:"), "before"), F.concat(F.lit("B:"), last, F.lit(" _ "), "after"))).alias("pattern"))
        side = F.broadcast(patterns) if n <= max_broadcast else patterns
        best = free.join(side, "pattern").groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        added = best.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
        out = rows.join(added, "row", "left")
        order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
        every = F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
        spans = F.transform(F.sort_array(F.transform(every, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = out.withColumn("all_spans", spans)
    text_of = F.array_join(F.transform("all_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", *keep, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text_of.alias("spans"), "all_spans")


def _mask_batch(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if t and own:
            end, parts = 0, []
            for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= end:
                    parts += [t[end : s["start"]], f"[{s['kind'].upper()}]"]
                    end = s["end"]
                elif s["end"] > end:  # overlaps what is masked already
                    end = s["end"]
            t = "".join(parts) + t[end:]
        out.append(t)
    return pa.array(out, pa.string())


def mask(text, spans):
    """The text with each span replaced by its kind in brackets; overlapping spans are one."""
    return F.arrow_udf(_mask_batch, "string")(text, spans)


def find_personal_data_in_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_broadcast: int = 50_000, **settings) -> DataFrame:
    """``docs`` with every span in ``text`` masked; all rows and other columns stay. A null text stays null.

    Patterns are learned from all mentions, then each text is masked where it is: base spans are found
    again and spans of patterns are looked up among ``max_broadcast`` patterns at a time, so texts never move.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    found = F.arrow_udf(_find_batch, _FOUND)(F.col(text).cast("string"))
    near = scratch.keep(docs.select(F.explode(found["mentions"]).alias("m")).select("m.kind", "m.surface", "m.before", "m.after"))
    patterns = scratch.keep(learn_patterns(near, scratch, **settings))
    scratch.drop(near)
    n = patterns.count()
    if n <= max_broadcast:
        shared = spark.sparkContext.broadcast(_by_pattern(patterns))
        return docs.withColumn(text, _masker(shared)(F.col(text).cast("string")))
    ranked = patterns.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(max(1, -(-n // max_broadcast)))))
    added = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    for part in range(-(-n // max_broadcast)):
        shared = spark.sparkContext.broadcast(_by_pattern(ranked.where(F.col("part") == part)))
        added = F.concat(added, _matcher(shared)(F.col(text).cast("string")))
    base = F.arrow_udf(_base_batch, "array<struct<kind:string,start:int,end:int>>")(F.col(text).cast("string"))
    return docs.withColumn(text, mask(F.col(text).cast("string"), F.concat(base, added)))


def _base_batch(texts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in base_spans(t or "")] for t in texts.to_pylist()], pa.list_(_SPAN))


def _by_pattern(patterns: DataFrame) -> dict[str, str]:
    """The likeliest kind of each pattern; the caller bounds their number."""
    rows = patterns.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")).toArrow()
    return dict(zip(rows["pattern"].to_pylist(), rows["kind"].to_pylist(), strict=True))


def _matches(text: str, spans: list[Span], kinds: dict[str, str]) -> list[Span]:
    """Spans that patterns add to the base spans of a text."""
    out: list[Span] = []
    for a, b, kind, _, before, after in mentions(text, spans):
        if kind is None and before:
            hit = kinds.get(f"L:{before}") or kinds.get(f"B:{before.split(' ')[-1]} _ {after}")
            if hit:
                out.append((hit, a, b))
    return out


def _dicts(spans: list[Span]) -> list[dict]:
    return [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]


def _matcher(shared):
    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def match(texts: pa.Array) -> pa.Array:
        return pa.array([_dicts(_matches(t, base_spans(t), shared.value)) if t else [] for t in texts.to_pylist()], pa.list_(_SPAN))

    return match


def _masker(shared):
    """Finding and masking in one pass."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            own = base_spans(t) if t else []
            rows.append(_dicts(own + _matches(t, own, shared.value)) if t else [])
        return _mask_batch(texts, pa.array(rows, pa.list_(_SPAN)))

    return run
