"""URL filters: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower

_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Rule:
    """``host`` covers its subdomains; ``path`` is a literal prefix of the url's path."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        """``example.org/en/1``: host up to the first slash, path from it on."""
        if verdict not in ("allow", "block"):
            raise ValueError(f"a verdict is allow or block, not {verdict!r}")
        host, slash, path = text.partition("/")
        return cls(verdict, host.translate(_LOWER), slash + path)

    @property
    def rank(self) -> tuple[int, int, bool]:
        """The longest text wins, then the longest host, then block."""
        return len(self.host) + len(self.path), len(self.host), self.verdict == "block"


@dataclass
class _Paths:
    below: dict = field(default_factory=dict)
    tails: dict = field(default_factory=dict)
    longest: int = 0


@dataclass
class _Hosts:
    below: dict = field(default_factory=dict)
    paths: _Paths | None = None
    bare: Rule | None = None


class Trie:
    """Host labels from the last to the first, then whole path segments, then the start of a segment."""

    def __init__(self, rules: Iterable[Rule]):
        self.top = _Hosts()
        for rule in rules:
            node = self.top
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, _Hosts())
            if not rule.path:
                node.bare = self._better(node.bare, rule)
                continue
            *whole, tail = rule.path[1:].split("/")
            at = node.paths = node.paths or _Paths()
            for segment in whole:
                at = at.below.setdefault(segment, _Paths())
            at.tails[tail] = self._better(at.tails.get(tail), rule)
            at.longest = max(at.longest, len(tail))

    @staticmethod
    def _better(old: Rule | None, new: Rule) -> Rule:
        return new if old is None or new.rank > old.rank else old

    def match(self, host: str, path: str) -> Rule | None:
        best, node, segments = None, self.top, path[1:].split("/") if path.startswith("/") else []
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.bare:
                best = self._better(best, node.bare)
            at = node.paths
            for segment in segments if at else ():
                for n in range(min(len(segment), at.longest), -1, -1):
                    if found := at.tails.get(segment[:n]):
                        best = self._better(best, found)
                        break
                at = at.below.get(segment)
                if at is None:
                    break
        return best


def _judge(trie):
    @F.pandas_udf("rule string, verdict string, a int, b int, c boolean")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        hits = [match(h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame([(None, None, -1, -1, False) if r is None else (r.host + r.path, r.verdict, *r.rank) for r in hits], columns=["rule", "verdict", "a", "b", "c"])

    return judge


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", default: str = "allow", rules_per_trie: int = 50_000) -> DataFrame:
    """Add ``host, path, rule, verdict`` (columns of these names are replaced).

    ``rules``: (verdict, text) pairs such as ``("block", "example.org/es/")``. Of all rules that fit, the
    one with the longest text wins, then the one with the longest host, then block over allow. Where none
    fits, ``rule`` is null and ``verdict`` is ``default``. Null urls and urls without ``://`` have an empty
    host and path. Host and path are cut in the JVM; only these two columns reach Python.

    The rules are a list in the driver's memory, and what is broadcast is as large as that list: tries of
    at most ``rules_per_trie`` rules, judged in turn, each carrying the best match so far. Rows never move.
    Long urls are judged whole, repeated rows alike; without rules every row gets ``default``, and an empty
    table gives no rows.
    """
    at = F.coalesce(F.col(url).cast("string"), F.lit(""))
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    df = df.withColumns({"host": ascii_lower(F.regexp_extract(at, cut, 1)), "path": F.regexp_extract(at, cut, 2)})
    parsed = [Rule.parse(v, t) for v, t in rules]
    spark = df.sparkSession
    found = F.lit(None).cast("struct<rule:string,verdict:string,a:int,b:int,c:boolean>")
    for i in range(0, len(parsed), rules_per_trie):
        judge = _judge(spark.sparkContext.broadcast(Trie(parsed[i : i + rules_per_trie])))
        one = judge("host", "path")
        if len(parsed) <= rules_per_trie:
            found = one
        else:
            rank = lambda x: F.struct(x["a"], x["b"], x["c"])
            df = df.withColumn("_url_one", one).withColumn("_url_best", found if i == 0 else F.col("_url_best"))
            df = df.withColumn("_url_best", F.when(F.col("_url_best").isNull() | (rank(F.col("_url_one")) > rank(F.col("_url_best"))), F.col("_url_one")).otherwise(F.col("_url_best"))).drop("_url_one")
            found = F.col("_url_best")
    df = df.withColumn("_url_best", found)
    return df.withColumns({"rule": F.col("_url_best.rule"), "verdict": F.coalesce("_url_best.verdict", F.lit(default))}).drop("_url_best")
