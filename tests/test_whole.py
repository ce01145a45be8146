"""Registered queries read their whole tables: against brute force."""

import hashlib

import pytest

from quire.queries import QUERIES

TEXTS = {i: "\n".join(f"Line {j} of {i}" for j in range(i % 3 + 1)) for i in range(1, 24)}


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en") for i, t in TEXTS.items()], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return at


def test_html_round_trip_reads_every_document(spark, documents):
    got = QUERIES["html_round_trip"](spark, documents).collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(i, len(t)) for i, t in TEXTS.items()]


def test_decoded_files_reads_every_document(spark, documents):
    got = QUERIES["decoded_files"](spark, documents).collect()
    want = [(i, hashlib.sha256(t.encode()).hexdigest(), "utf-8" if i % 3 else "utf-16-le", i % 3 == 0) for i, t in TEXTS.items()]
    assert sorted((r.doc_id, r.text_hash, r.encoding, r.bom) for r in got) == want


@pytest.mark.parametrize("name", ["epub_chapters", "tex_blocks"])
def test_every_line_comes_back(spark, documents, name):
    words = {}
    for r in sorted(QUERIES[name](spark, documents).collect(), key=lambda r: (r.doc_id, r["pos"])):
        words.setdefault(r.doc_id, []).extend((r["text"] or "").split())
    if name == "tex_blocks":  # the section of the language stands first
        assert all(w.pop(0) == "en" for w in words.values())
    assert words == {i: t.split() for i, t in TEXTS.items()}


def test_latex_metrics_takes_no_prefix(spark, documents):
    """Backslashes are taken out of the texts, so counts can't show how much of one was read; the plan can."""
    df = QUERIES["latex_metrics"](spark, documents)
    assert "substring" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in df.collect()) == [(i, 1, 0, 1, 1, 1) for i in TEXTS]


ORDERS = [(i, 1 + i * 7 % 40) for i in range(1, 1200)]
ITEMS = [(i, j, 1 + i * 5 % 31, 1 + (i + j) * 3 % 17) for i in range(1, 24) for j in range(1, i % 7 + 2)]


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("star"))
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(ITEMS, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(i, f"Brand#{i}", i * 3 % 50) for i in range(1, 24)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{at}/part.parquet")
    return at


def test_toc_has_every_order(spark, star):
    got = {(r.page_id, r.pos): r.parent_pos for r in QUERIES["toc_parents"](spark, star).collect()}
    want = {}
    for k, _ in ORDERS:
        levels = [(k * 7 + i * i * 3 + i) % 4 + 1 for i in range(8)]
        for i, level in enumerate(levels):
            want[k, i * 3] = max((j * 3 for j in range(i) if levels[j] < level), default=None)
    assert got == want


def test_dense_cache_has_every_order(spark, star):
    got = {r.l_orderkey: r.dense.split() for r in QUERIES["dense_cache"](spark, star).collect()}
    at = {(k, j): str(s) for k, j, _, s in ITEMS}
    assert got == {k: [at.get((k, j), "-") for j in range(8)] for k in {r[0] for r in ITEMS}}


def test_every_item_has_a_place_in_its_grid(spark, star):
    got = {}
    for r in QUERIES["table_grid"](spark, star).collect():
        got.setdefault(r.t, []).append(r)
    assert {t: len(c) for t, c in got.items()} == {k: k % 7 + 1 for k in range(1, 24)}
    for cells in got.values():  # no two cells that start in the grid cover one place
        seen = [(r.row_ix + i, r.grid_col + j) for r in cells for i in range(r.row_span) for j in range(r.col_span)]
        assert len(seen) == len(set(seen))


def test_every_usage_has_a_font(spark, star):
    got = {r.usage_id: r for r in QUERIES["font_substitution"](spark, star).collect()}
    assert sorted(got) == list(range(1, 24))
    assert all(r.exact == (k <= 19) and (not r.exact or r.face_family == f"Brand#{k}") for k, r in got.items())


def test_graphs_have_every_order(spark, star):
    number = {k: i for i, k in enumerate(sorted({k for e in ORDERS for k in e}))}
    up, met = list(range(len(number))), set()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in ORDERS:
        if a != b:
            i, j = root(number[a]), root(number[b])
            up[max(i, j)] = min(i, j)
            met |= {a, b}
    least = {}
    for k in sorted(met):
        least.setdefault(root(number[k]), k)
    got = {r.node: r.component for r in QUERIES["connected_groups"](spark, star).collect()}
    assert got == {k: least[root(number[k])] for k in met} and len(got) > 700

    groups = {}
    for k, c in ORDERS:
        groups.setdefault(c, []).append(k)
    want = [(min(-2 * c - 1, -2 * max(ks) - 2), ",".join(sorted(map(str, ks))), min(k % 5 for k in ks) + 1) for c, ks in groups.items()]
    got = [tuple(r) for r in QUERIES["mapping_composition"](spark, star).select("group_id", "sources", "rank").collect()]
    assert sorted(got) == sorted(want)
