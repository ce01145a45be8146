"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi search.

The automaton over all pieces reads a text once. At each position the matches that end there (the
automaton's output links, longest first) relax the best path up to it. What "best" means is the model's:

* a unigram model: the largest sum of piece scores;
* a BPE model: scores are merge ranks, not log probabilities, and summing them doesn't give what merging
  gives. A path is the result of merging exactly if each two neighbours on it are left alone when merged by
  themselves; so a piece relaxes a position only if that holds for it and the last piece of the best path
  before it. There is one such path to each position that merging can stop at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Kinds of pieces and models in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How much an unknown character scores below the worst piece of a unigram model (fixed value).
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


class _Memory(dict):
    """Results of ``make`` by key. Two generations of at most ``most`` each: what is used again moves to
    the younger one, and the older one is dropped when that is full. Very long strings aren't kept."""

    def __init__(self, make, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if key.__class__ is str and len(key) > self.longest:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class PieceModel:
    """A SentencePiece model file: unigram or BPE, with the identity normaliser. A process remembers the ids of
    at most twice ``memory`` words, and as many pairs."""

    def __init__(self, data: bytes, memory: int = 200_000):
        self.memory = memory
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.byte_fallback, self.dummy_prefix = UNIGRAM, False, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(float(np.frombuffer(own.get(2, b"\0" * 4), "<f4")[0]))
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.kind, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                self.dummy_prefix = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1) or not own.get(5, 1):
                    raise ValueError("only the identity normaliser that keeps and escapes white space is known")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("a unigram or BPE model is needed")
        if USER_DEFINED in self.kinds:
            raise ValueError("user-defined pieces aren't known")
        self.unk = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}

    def __getstate__(self):
        """What a worker can't or needn't be sent is built there on first use."""
        made = {k for k, v in vars(type(self)).items() if isinstance(v, cached_property)}
        return {k: v for k, v in self.__dict__.items() if k not in made}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for p, i in self.ids.items():
            out.add_word(p, (len(p), i))
        out.make_automaton()
        return out

    @cached_property
    def bridges(self) -> bool:
        """Whether a piece holds a space behind another character, so that words aren't independent."""
        return any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def _spell(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_fallback else [self.unk]

    @cached_property
    def _floor(self) -> float:
        return min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY

    def _unigram(self, s: str) -> list[tuple[str, int]]:
        n, floor = len(s), self._floor
        best, last = [0.0] + [-np.inf] * n, [None] * (n + 1)
        at = 0

        def settle(upto: int) -> None:
            """A position that no piece of one character reaches takes an unknown one."""
            nonlocal at
            while at < upto:
                at += 1
                if s[at - 1] not in self.ids and best[at - 1] + floor > best[at]:
                    best[at], last[at] = best[at - 1] + floor, (1, -1, s[at - 1])

        for end, match in self.automaton.iter(s):
            settle(end)  # positions before this end are final, and so what starts there
            size, i = match
            score = best[end + 1 - size] + self.scores[i]
            if score > best[end + 1]:
                best[end + 1], last[end + 1] = score, (size, i, self.pieces[i])
        settle(n)
        return self._back(last, n)

    def _bpe(self, s: str) -> list[int]:
        """Every position has one path, so the first admissible match at an end settles it."""
        n, size_of, pieces = len(s), len(self.pieces), self.pieces
        last = [-1] * (n + 1)
        last[0] = size_of  # stands for the beginning
        stands = self._pairs
        for end, (size, i) in self.automaton.iter(s):
            end += 1
            if last[end] < 0 and stands[last[end - size] * size_of + i]:
                last[end] = i
        out = []
        while n:
            out.append(last[n])
            n -= len(pieces[last[n]])
        out.reverse()
        return out

    @staticmethod
    def _back(last: list, n: int) -> list[tuple[str, int]]:
        out = []
        while n:
            size, i, p = last[n]
            out.append((p, i))
            n -= size
        return out[::-1]

    def _merge(self, s: str) -> list[str]:
        """Merging from characters: the best-scored pair of neighbours first, the leftmost of equals."""
        parts = list(s)
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = self.scores[i], k
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _stands(self, key: int) -> bool:
        """Whether merging two pieces by themselves gives the two; at a beginning, whether merging gives the
        piece. ``key`` is the left id (the number of pieces at a beginning) times that number plus the right one."""
        before, i = divmod(key, len(self.pieces))
        want = [self.pieces[i]] if before == len(self.pieces) else [self.pieces[before], self.pieces[i]]
        return self._merge("".join(want)) == want

    def _ids(self, s: str) -> tuple[int, ...]:
        """A character that no piece has is a part of its own; nothing merges with it."""
        if self.kind == BPE:
            if self._known.issuperset(s):
                return tuple(self._bpe(s))
            out: list[int] = []
            for known, part in groupby(s, self._known.__contains__):
                if known:
                    out += self._bpe("".join(part))
                    continue
                for c in part:
                    out += self._spell(c) if self.byte_fallback or out[-1:] != [self.unk] else []
            return tuple(out)
        out = []
        for p, i in self._unigram(s):
            if i >= 0:
                out.append(i)
            elif self.byte_fallback or out[-1:] != [self.unk]:  # a run of unknown characters is one
                out += self._spell(p)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text. Where no piece crosses from a word into the next one's space, words are
        independent, and each distinct one is searched once (the memory of them is bounded)."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if self.bridges or not self.byte_fallback:
            return list(self._ids((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)))
        head, *words = text.split(" ")
        if self.dummy_prefix:
            words.insert(0, head)
        out = [] if self.dummy_prefix else list(self._segments(head))
        if "" not in words:
            out.extend(chain.from_iterable(map(self._words.__getitem__, words)))
            return out
        blanks = 0
        for w in words:
            if not w:
                blanks += 1
                continue
            out += self._segments(SPACE * (blanks + 1) + w) if blanks else self._words[w]
            blanks = 0
        if blanks:
            out += self._segments(SPACE * blanks)
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        return self._segments(SPACE + word)

    def _segments(self, s: str) -> tuple[int, ...]:
        """Ids of a string, cut where no piece has the two characters beside each other."""
        if s.isalpha() or s[1:].isalpha():  # letters are rarely parted, and cutting isn't needed
            return self._ids(s)
        joined, cut, out = self._joined, 0, ()
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in joined:
                out += self._part(s[cut:i])
                cut = i
        return out + self._part(s[cut:]) if s else ()

    def _part(self, s: str) -> tuple[int, ...]:
        """A part that is a word by itself is remembered as one."""
        return self._words[s[1:]] if s[0] == SPACE and s[1:].isalpha() else self._parts[s]

    @cached_property
    def _joined(self) -> frozenset[str]:
        return frozenset(p[i : i + 2] for p in self.ids for i in range(len(p) - 1))

    @cached_property
    def _known(self) -> frozenset[str]:
        return frozenset(p for p in self.ids if len(p) == 1)

    @cached_property
    def _pairs(self) -> _Memory:
        return _Memory(self._stands, self.memory)

    @cached_property
    def _words(self) -> _Memory:
        return _Memory(self._word, self.memory)

    @cached_property
    def _parts(self) -> _Memory:
        return _Memory(self._ids, self.memory // 5)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are joined and read as UTF-8 (bad ones become U+FFFD), control pieces
        vanish, and the prefix that encoding added is taken off."""
        table = self._texts
        try:
            text = "".join(map(table.__getitem__, ids))
        except TypeError:  # a byte that is part of a character
            text = self._with_bytes(ids)
        return text[1:] if self.dummy_prefix and text[:1] == " " else text

    def _with_bytes(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        table = self._texts
        for i in ids:
            if (b := table[i]).__class__ is int:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(b)
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    @cached_property
    def _texts(self) -> list[str | int]:
        """Bytes under 128 are characters whatever stands beside them; the others stay numbers."""
        byte = lambda b: chr(b) if b < 128 else b
        shown = {CONTROL: lambda p: "", UNKNOWN: lambda p: " ⁇ ", BYTE: lambda p: byte(int(p[3:5], 16))}
        return [shown.get(k, lambda p: p.replace(SPACE, " "))(p) for p, k in zip(self.pieces, self.kinds, strict=True)]


def load_model(path: str, memory: int = 200_000) -> PieceModel:
    """Read a model file on the driver; it reaches the executors by broadcast (its size is the vocabulary's)."""
    with open(path, "rb") as f:
        return PieceModel(f.read(), memory)


def _int_lists(rows: Iterable[list[int] | None]) -> pa.Array:
    """A list array whose values go into one buffer row by row."""
    values, offsets, missing = array("i"), array("i", [0]), []
    for r in rows:
        missing.append(r is None)
        values.extend(r or ())
        offsets.append(len(values))
    as_ints = lambda a: pa.Array.from_buffers(pa.int32(), len(a), [None, pa.py_buffer(a)])
    return pa.ListArray.from_arrays(as_ints(offsets), as_ints(values), mask=pa.array(missing, pa.bool_()))


def encode_documents(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` (replaced if there). A null text gets null, an empty one no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        run = shared.value.encode
        return _int_lists(run(t.as_py()) if t.is_valid else None for t in texts)

    return docs.withColumn("ids", encode(F.col(text).cast("string")))


def decode_documents(docs: DataFrame, model: PieceModel, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids`` in ``into`` (replaced if there); null gives null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        run = shared.value.decode
        return pa.array([run(r.values.to_numpy().tolist()) if r.is_valid else None for r in rows], pa.string())

    return docs.withColumn(into, decode(F.col(ids)))


def recode_documents(docs: DataFrame, model: PieceModel, text: str = "text", into: str = "decoded") -> DataFrame:
    """Both in one pass: ``docs`` with ``ids``, and their text again in ``into``. Chained, Spark would encode
    once for the ids and again for the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("ids array<int>, decoded string")
    def recode(texts: pa.Array) -> pa.Array:
        m = shared.value
        back: list[str | None] = []

        def rows() -> Iterator[list[int] | None]:
            for t in texts:
                ids = m.encode(t.as_py()) if t.is_valid else None
                back.append(None if ids is None else m.decode(ids))
                yield ids

        lists = _int_lists(rows())
        return pa.StructArray.from_arrays([lists, pa.array(back, pa.string())], ["ids", "decoded"])

    both = docs.withColumn("_r", recode(F.col(text).cast("string")))
    return both.withColumns({"ids": F.col("_r.ids"), into: F.col("_r.decoded")}).drop("_r")
