"""What several of the operators in this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points 9 to 13 and the space.
BLANKS = "\t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4, is 2; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once a row and hand it to ``use`` as a bound variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts of its runs) for an input sorted by the integer columns ``keys``; no run is cut.

    A run may span record batches; only the last run of each batch is carried over.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            v = table[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), starts[:-1]
        rest = table.slice(starts[-1])
    if rest is not None:
        yield rest.combine_chunks(), np.zeros(1, int)


def cells(df: DataFrame, size: str, row_id: str, cap: Column) -> DataFrame:
    """Add ``cell_i, cell_j, chunk``: a group of more than ``cap`` rows is dealt into chunks by its rows'
    ids, and each pair of chunks becomes a cell, so that all pairs of rows meet in one cell each and no
    cell holds much more than ``2 * cap`` rows. Groups up to ``cap`` are one cell and aren't copied."""
    n = F.greatest(F.ceil(F.col(size) / cap), F.lit(1)).cast("int")
    df = df.withColumn("_n", n).withColumn("chunk", F.pmod(F.xxhash64(row_id), F.col("_n").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return df.withColumn("_o", other).withColumn("cell_i", F.least("chunk", "_o")).withColumn("cell_j", F.greatest("chunk", "_o")).drop("_n", "_o")


class Forest:
    """Union-find over 0 to n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """True if they weren't joined before."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def binary_rows(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Null as empty."""
    return [b"" if x is None else x for x in column.to_pylist()]
