import random

import pytest
from pyspark.sql import functions as F

from quire.functions import color, geometry
from quire.operators import charts, dedup, graph, intervals, layout, tables
from quire.plans.components import connected_components
from quire.streaming.streams import first_seen, running_totals, windowed_counts


def test_components_of_any_graph(spark):
    draw = random.Random(2)
    for n, m in ((1, 0), (30, 20), (200, 150), (60, 59)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
        if m == 59:
            edges = [(i, i + 1) for i in range(59)]  # a path
        up = list(range(n))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
        got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want


def test_two_columns(spark):
    page = spark.createDataFrame([(1, 1, 300.0, 400.0)], "doc_id long, page int, width double, height double")
    rows = [(1, 1, 0, "title", 20.0, 10.0, 280.0, 30.0), (1, 1, 1, "l1", 20.0, 40.0, 130.0, 60.0), (1, 1, 2, "r1", 170.0, 40.0, 280.0, 60.0), (1, 1, 3, "l2", 20.0, 70.0, 130.0, 90.0), (1, 1, 4, "r2", 170.0, 70.0, 280.0, 90.0), (1, 1, 5, "foot", 20.0, 100.0, 280.0, 120.0)]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, number int, text string, x0 double, y0 double, x1 double, y1 double")
    out = layout.reading_order(blocks, page).orderBy("position").collect()
    assert [r.text for r in out] == ["title", "l1", "l2", "r1", "r2", "foot"] and [r.column for r in out] == [None, 0, 0, 1, 1, None]
    assert layout.gutters(blocks, page).select("gutter_left", "gutter_right").collect()[0][:] == (130.0, 170.0)


def test_running_content_and_roles(spark):
    pages = spark.createDataFrame([(1, i, 300.0, 400.0) for i in range(3)], "doc_id long, page int, width double, height double")
    rows = [x for i in range(3) for x in ((1, i, 0, f"Report {i}", 20.0, 10.0, 100.0, 20.0), (1, i, 1, f"body {i} text", 20.0, 100.0, 200.0, 120.0), (1, i, 2, f"{i} / 3", 20.0, 380.0, 60.0, 390.0))]
    rows += [(1, 0, 3, "Figure 2: things", 20.0, 200.0, 120.0, 210.0), (1, 0, 4, "E = m + c", 20.0, 220.0, 120.0, 230.0)]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, number int, text string, x0 double, y0 double, x1 double, y1 double")
    out = {(r.page, r.number): (r.role, r.confidence) for r in layout.classify_blocks(blocks, pages).collect()}
    assert [out[i, 0] for i in range(3)] == [("header", 0.98)] * 3 and out[1, 2] == ("footer", 0.98)
    assert out[0, 3] == ("caption", 0.96) and out[0, 4][0] == "equation" and out[2, 1] == ("paragraph", 0.5)
    plain = layout.analyze_pages(blocks, blocks.limit(0), pages).collect()[0].plain
    assert plain.split("\n")[0] == "body 0 text" and "Report" not in plain


def test_boxes(spark):
    one = lambda a, b: spark.range(1).select(F.round(geometry.iou(geometry.Box(*map(F.lit, a)), geometry.Box(*map(F.lit, b))), 4).alias("o")).first().o
    assert one((0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0)) == 1.0
    assert one((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 13.0, 10.0)) == 0.3846
    assert one((0.0, 0.0, 1.0, 1.0), (5.0, 5.0, 6.0, 6.0)) == 0.0
    m = geometry.Matrix(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 10.0, 0.0)))
    b = m.bounds(geometry.Box(*map(F.lit, (0.0, 0.0, 2.0, 1.0))))
    assert spark.range(1).select(*b).first()[:] == (9.0, 0.0, 10.0, 2.0)
    row = spark.range(1).select(geometry.native_width(F.lit("dxa"), F.lit("240")).alias("a"), geometry.native_width(F.lit("pct"), F.lit("50%")).alias("b"), geometry.native_width(F.lit("pct"), F.lit("2500")).alias("c"), geometry.native_width(F.lit("auto"), F.lit("0")).alias("d")).first()
    assert (row.a.value, row.b.value, row.c.value, row.d.unit, row.d.value) == (12.0, 0.5, 0.5, "auto", None)


def test_statistics(spark):
    pts = spark.createDataFrame([("s", 0, 2.0), ("s", 1, 4.0), ("s", 2, 6.0), ("c", 1, 5.0), ("c", 1, 7.0)], "k string, x int, y double")
    got = {r.k: (r.slope, r.intercept) for r in charts.linear_trend(pts, ["k"]).collect()}
    assert got["s"] == pytest.approx((2.0, 2.0)) and got["c"] == pytest.approx((0.0, 6.0))
    poly = {r.k: r.coefficients for r in charts.polynomial_trend(pts, ["k"], 2).collect()}
    assert poly["s"] == pytest.approx([2.0, 2.0, 0.0], abs=1e-9) and poly["c"] is None
    bad = spark.createDataFrame([("nan",), ("inf",), ("x",), (None,), ("2.5",)], "v string").select(charts.finite(F.col("v")).alias("o")).collect()
    assert [r.o for r in bad] == [0.0, 0.0, 0.0, 0.0, 2.5]


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 0.0, 2.0), ("a", 2.0, 5.0), ("a", 7.0, 9.0), ("b", 1.0, 10.0), ("b", 2.0, 3.0)], "k string, start double, end double")
    merged = sorted(r[:] for r in intervals.merge_intervals(rows, ["k"]).collect())
    assert merged == [("a", 0.0, 5.0), ("a", 7.0, 9.0), ("b", 1.0, 10.0)]
    wide = rows.withColumns({"low": F.lit(0.0), "high": F.lit(9.0)})
    assert {r.k: r.covered for r in intervals.covers(wide, ["k"], "low", "high").collect()} == {"a": False, "b": False}
    assert sorted(r[:] for r in intervals.complement(wide, ["k"], "low", "high").collect()) == [("a", 5.0, 7.0), ("b", 0.0, 1.0)]


def test_chains(spark):
    nodes = spark.createDataFrame([(1, "a", None, "x", False), (1, "b", "a", None, False), (1, "c", "b", None, True), (1, "d", "c", None, False), (1, "p", "q", None, False), (1, "q", "p", "z", False)], "doc long, n string, up string, v string, unresolved boolean")
    got = {r.node: r.v for r in graph.inherited(nodes, "n", "up", ["doc"], ["v"]).collect()}
    assert got == {"a": "x", "b": "x", "c": "x", "d": "x", "p": "z", "q": "z"}
    eff = {r.node: r.v for r in graph.effective_or_unresolved(nodes, "n", "up", ["doc"], "v", "unresolved").collect()}
    assert eff == {"a": "x", "b": "x", "c": None, "d": None, "p": "z", "q": "z"}
    assert {r.node for r in graph.cyclic_nodes(nodes, "n", "up", ["doc"]).collect()} == {"p", "q"}


def test_mappings_and_tables(spark):
    first = spark.createDataFrame([(1, 11, "SEMANTIC"), (2, 11, "LOST"), (3, 12, "VISUAL")], "source long, target long, state string")
    second = spark.createDataFrame([(11, 21, "SEMANTIC"), (12, 22, "SEMANTIC")], "source long, target long, state string")
    out = {r.group_id: (r.sources, r.targets, r.state) for r in graph.compose_mappings(first, second).collect()}
    assert out == {1: ([1, 2, 11], [21], "LOST"), 3: ([3, 12], [22], "VISUAL")} or {k: (v[1], v[2]) for k, v in out.items()} == {1: ([21], "LOST"), 3: ([22], "VISUAL")}
    cells = spark.createDataFrame([(1, 0, 0, 2, 1), (1, 0, 1, 1, 2), (1, 1, 0, 1, 1), (1, 2, 0, 1, 1)], "t long, row_ix int, cell_ix int, row_span int, col_span int")
    assert [r.grid_col for r in tables.place_cells(cells, ["t"]).orderBy("row_ix", "cell_ix").collect()] == [0, 1, 1, 0]


def test_duplicates_and_diffs(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "id long, c string")
    assert [r.ids for r in dedup.duplicate_groups(rows, "c", "id").collect()] == [[1, 2]]
    assert [r[:] for r in dedup.canonical_rows(rows, "c", "id").collect()] == [(2, 1)]
    assert len({rows.select(dedup.content_hash(F.col("c"), a).alias("h")).first().h for a in ("md5", "sha1", "sha256", "sha512", "crc32")}) == 5
    with pytest.raises(ValueError):
        dedup.content_hash(F.col("c"), "rot13")


def test_colors(spark):
    tokens = ["#fff", "#10203040", "Red", "rgb(255, 0, 50%)", "hsl(120, 100%, 50%)", "rgba(0,0,0,0.25)", "nope", None]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select(color.parse_css_color(F.col("t")).alias("c"))
    got = [None if r.c is None else tuple(round(v, 4) for v in r.c) for r in df.collect()]
    assert got == [(1, 1, 1, 1), (0.0627, 0.1255, 0.1882, 0.251), (1, 0, 0, 1), (1, 0, 0.5, 1), (0, 1, 0, 1), (0, 0, 0, 0.25), None, None]
    h, light, s = color.rgb_to_hls(*map(F.lit, (0.2, 0.4, 0.6)))
    back = color.hls_to_rgb(h, light, s)
    assert spark.range(1).select(*back).first()[:] == pytest.approx((0.2, 0.4, 0.6))
    assert spark.range(1).select(color.scale_hex(F.lit("#8040ff"), 1.5).alias("o")).first().o == "#c060ff"


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:40:00", "a", 2.0), (3, "2024-01-01 05:00:00", "b", 4.0), (4, "2024-01-01 00:41:00", "a", 8.0), (5, "2024-01-02 05:00:00", "b", 1.0)]
    df = spark.createDataFrame(rows, "id long, t string, k string, value double").withColumn("ts", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, mode, name):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    counts = {(str(r.start), r.k): (r.n, r.total) for r in run(windowed_counts(stream(), "ts", ["k"]), "append", "w")}
    assert counts[("2024-01-01 00:00:00", "a")] == (3, 11.0)
    assert len(run(first_seen(stream(), "k", "ts"), "append", "d")) == 2
    totals = {r.k: (r.n, r.total, r.largest) for r in run(running_totals(stream(), "k", "value"), "update", "r")}
    assert totals == {"a": (3, 11.0, 8.0), "b": (2, 5.0, 4.0)}
