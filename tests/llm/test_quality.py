import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.quality import beta_prior, judge_documents


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


EDGES = [None, "", " \t\n", "one", "a b " * 30, "a b c d e f g h " * 2, "x\n" * 40, "#*$%&|<> é ü\x0b𝒳\r\n z", " ".join(map(str, range(3000))), "same line\nsame line\n\n \nother", "w " * 5000, "\u00a0 nbsp\u2028sep", "q" * 100_000]


def test_counts_agree_with_brute_force(spark):
    rows = [(i, t, f"h{i % 2}", 7) for i, t in enumerate(EDGES)]
    out = judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(EDGES[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab \n#", max_size=120), min_size=1, max_size=20))
def test_any_texts(spark, texts):
    rows = [(i, t, None) for i, t in enumerate(texts)]
    for r in judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "short"
    rows = [(i, good if i % 10 else bad, "clean") for i in range(100)] + [(100 + i, bad if i % 10 else good, "spam") for i in range(100)] + [(200, good, None), (201, bad, None), (202, good, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for kept in (judge_documents(docs), judge_documents(docs, broadcast_hosts=0)):
        out = {r.doc_id: r for r in kept.collect()}
        assert len(out) == 203
        assert out[1].kept and not out[0].kept and not out[100].kept
        assert not out[100].base_failed and out[101].base_failed  # the host of 100 is rejected
        assert out[200].kept and out[202].kept
        assert 0 < out[202].host_failure < 0.5  # shrunk from 0
    assert judge_documents(docs.limit(0)).count() == 0


def test_prior():
    a, b = beta_prior(0.2, 0.01)
    assert a / (a + b) == pytest.approx(0.2) and a * b / ((a + b) ** 2 * (a + b + 1)) == pytest.approx(0.01)
    assert beta_prior(0.2, 0.0) == pytest.approx((4.0, 16.0)) and beta_prior(0.5, 0.25)[0] == 10
