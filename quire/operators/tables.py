"""Table grids: placing spanning cells, vertical merges, and text of rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def place_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Add ``grid_col`` to cells (row_ix, cell_ix, row_span, col_span): a cell moves right past columns that a
    cell of an earlier row still holds. A table's cells are one array: occupancy is a state of its rows; many
    tables are worked on in a batch."""
    rest = [c for c in cells.columns if c not in (*by, "row_ix", "cell_ix", "grid_col")]
    whole = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("row_ix", "cell_ix", *rest))).alias("_c"))
    part = lambda n: F.transform("_c", lambda c: c[n].cast("int"))
    placed = whole.withColumn("_g", F.arrow_udf(_columns_of, "array<int>")(part("row_ix"), part("row_span"), part("col_span")))
    out = placed.select(*by, F.explode(F.arrays_zip("_c", "_g")).alias("_x"))
    return out.select(*[c if c in by else F.col("_x._c")[c].alias(c) for c in cells.columns if c != "grid_col"], F.col("_x._g").alias("grid_col"))


def _columns_of(rows: pa.Array, high: pa.Array, wide: pa.Array) -> pa.Array:
    """The column of each cell of each table, from their rows and spans in order."""
    found = []
    for table in zip(rows.to_pylist(), high.to_pylist(), wide.to_pylist(), strict=True):
        until: dict[int, int] = {}
        at, row, out = 0, None, []
        for r, h, w in zip(*table, strict=True):
            if r != row:
                row, at = r, 0
            while any(until.get(at + i, 0) > r for i in range(w)):
                at += 1
            until.update(dict.fromkeys(range(at, at + w), r + h))
            out.append(at)
            at += w
        found.append(out)
    return pa.array(found, pa.list_(pa.int32()))


def merge_down(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, grid_col, row_ix, row_span) of cells that start a run: a cell with ``merge`` = 'continue' prolongs
    the cell above it in its column; a continuation without a start is a run of its own."""
    w = Window.partitionBy(*by, "grid_col").orderBy("row_ix")
    starts = F.coalesce(F.col("merge") != "continue", F.lit(True)) | (F.row_number().over(w) == 1)
    runs = cells.withColumn("_run", F.sum(starts.cast("int")).over(w))
    return runs.groupBy(*by, "grid_col", "_run").agg(F.min("row_ix").alias("row_ix"), F.count("*").cast("int").alias("row_span")).drop("_run")


def merge_faults(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells that are marked as covered but that no spanning cell covers, and spans that overlap."""
    a = cells.where("row_span > 1 OR col_span > 1").select(*by, F.col("row_ix").alias("r0"), (F.col("row_ix") + F.col("row_span")).alias("r1"), F.col("grid_col").alias("c0"), (F.col("grid_col") + F.col("col_span")).alias("c1"))
    inside = (F.col("row_ix") >= F.col("r0")) & (F.col("row_ix") < F.col("r1")) & (F.col("grid_col") >= F.col("c0")) & (F.col("grid_col") < F.col("c1")) & ~((F.col("row_ix") == F.col("r0")) & (F.col("grid_col") == F.col("c0")))
    keys = [*by, "row_ix", "grid_col"]
    met = cells.join(a, by).where(inside).select(*keys).distinct().withColumn("_in", F.lit(True))
    out = cells.join(met, keys, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    fault = F.when(F.col("covered") & ~F.col("_in"), "uncovered").when(~F.col("covered") & F.col("_in"), "overlap")
    return out.select(*keys, fault.alias("fault")).where("fault IS NOT NULL")


def table_text(cells: DataFrame, by: list[str], glue: str = " | ") -> DataFrame:
    """(by, text): cells joined within rows, rows by line ends."""
    rows = cells.groupBy(*by, "row_ix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_ix", "text"))), lambda c: c["text"]), glue).alias("_t"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_ix", "_t"))), lambda r: r["_t"]), "\n").alias("text"))


def number_items(items: DataFrame, lists: list[str], order: list[str], start: str | None = None) -> DataFrame:
    """Add ``list_value``: start (1 where null) plus the place in the list."""
    place = F.row_number().over(Window.partitionBy(*lists).orderBy(*order)) - 1
    return items.withColumn("list_value", place + (F.coalesce(F.col(start), F.lit(1)) if start else 1))


def merge_borders(cells: DataFrame, borders: DataFrame, by: list[str]) -> DataFrame:
    """Cells with their own border per side, else the table's."""
    sides = ("top", "left", "bottom", "right")
    t = borders.select(*by, *[F.col(s).alias(f"_{s}") for s in sides])
    out = cells.join(t, by, "left")
    return out.withColumns({s: F.coalesce(s, f"_{s}") for s in sides}).drop(*[f"_{s}" for s in sides])
