import base64
import time

import pytest

from quire.sources.css import Cascade, declarations, parse_selector, rules, size_points, without_comments
from quire.sources.html import Reader, metrics, parse, read_html

PNG = base64.b64encode(b"\x89PNG fake").decode()
PAGE = f"""<!DOCTYPE html><html lang="en"><head><title>T</title><style>p {{color:#778899}} .x b {{color: #aa0000 !important}} @page {{margin:0}}</style></head>
<body><h1 id="top1">Head  <i>ing</i></h1><p class="x" style="color:blue">One <b>two</b>
 three<br> four</p><ol start="3"><li>a<ul><li>b</li></ul></li><li>c</li></ol><ul><li><ul><li>deep</li></ul></li></ul>
<table><caption>Cap</caption><tr><th rowspan="2">H</th><td>12</td></tr><tr><td>± 1</td></tr></table>
<pre> keep
  this</pre><img alt="alt" src="data:image/png;base64,{PNG}"><img alt="gone" src="x.png">
<a href="#top1">in</a> <a href="javascript:x">bad</a><script>var t="</p>";</script><template>no</template><p hidden>no</p></body></html>"""


@pytest.fixture(scope="module")
def page():
    return Reader(PAGE)


def test_blocks(page):
    texts = [b["text"] for b in page.blocks]
    assert texts[:7] == ["Head ing", "One two three\nfour", "a", "b", "c", "", "deep"]
    assert [b["list_level"] for b in page.blocks[2:5]] == [0, 1, 0] and [b["list_value"] for b in page.blocks[2:5]] == [3, 1, 4]
    assert [b["list_id"] for b in page.blocks[2:7]] == [0, 1, 0, 2, 3]
    assert texts[7:11] == ["Cap", "H", "12", "± 1"]
    assert " keep\n  this" in texts and "no" not in "".join(texts)
    assert page.blocks[0]["level"] == 1 and page.blocks[0]["lang"] == "en"


def test_cells_links_images(page):
    assert [(c["row_ix"], c["grid_col"], c["row_span"], c["text"]) for c in page.cells] == [(0, 0, 2, "H"), (0, 1, 1, "12"), (1, 1, 1, "± 1")]
    assert [i["resource_id"][:5] for i in page.images] == ["html-"] and page.images[0]["media_type"] == "image/png"
    assert {m for _, m in page.warnings} >= {"image without embedded data", "link left out: javascript:x", "unsupported rule @page"}
    links = {r["link"] for r in page.runs}
    assert "#top1" in links and not any(x and x.startswith("java") for x in links)


def test_styles(page):
    by = {r["text"].strip(): r for r in page.runs}
    assert by["One"]["color"] == "blue" and by["two"]["color"] == "#aa0000" and by["two"]["bold"]
    assert by["Head"]["size"] == 24 and by["ing"]["italic"] and by["ing"]["bold"]


@pytest.mark.parametrize(("css", "want"), [("p{color:blue}", "blue"), ("p{color:red} p{color:blue}", "blue"), ("#a{color:red} p{color:blue}", "red"), ("p{color:red !important} #a{color:blue}", "red"), ("b p{color:red} div>p{color:blue}", "blue"), ("p{color:red} .k{color:blue} p{color:red}", "blue")])
def test_precedence(css, want):
    root = parse('<div><p id="a" class="k">x</p></div>')
    if "#a" not in css:
        root = parse('<div><p class="k">x</p></div>')
    p = next(n for n in root.walk() if n.tag == "p")
    assert Cascade([css]).style(p)["color"] == want


def test_sizes():
    root = parse('<div style="font-size:20pt"><p style="font-size:50%"><b style="font-size:2em">x</b></p></div>')
    c = Cascade([])
    sizes = {n.tag: c.style(n)["font-size"] for n in root.walk() if n.tag}
    assert sizes == {"div": "20pt", "p": "10pt", "b": "20pt"}
    assert size_points("16px") == 12 and size_points("1in") == 72 and size_points("nonsense", 7) == 7


def test_selectors():
    root = parse('<ul><li class="a">1</li><li data-x="q w">2</li><li>3</li></ul>')
    lis = [n for n in root.walk() if n.tag == "li"]
    fit = lambda s: [parse_selector(s).fits(n) for n in lis]
    assert fit("li.a") == [True, False, False] and fit("li.a + li") == [False, True, False] and fit("li.a ~ li") == [False, True, True]
    assert fit("ul > li:last-child") == [False, False, True] and fit("[data-x~=w]") == [False, True, False] and fit("ol li") == [False] * 3
    assert parse_selector("p:hover") is None and parse_selector("") is None and parse_selector("> p") is None
    assert parse_selector("#a .b[c] d").specificity == (1, 2, 1)
    assert without_comments('a/*x*/b "/*y*/"') == 'a b "/*y*/"'
    assert declarations("a: 1; b: 'x;y' !important") == [("a", "1", False), ("b", "'x;y'", True)]
    assert rules("@media screen{p{a:b}} @media print{q{c:d}} r{e:f}")[0] == [("p", "a:b"), ("r", "e:f")]


def test_nesting_has_no_implied_ends():
    root = parse("<p><b>a<p>b</p></i>c")
    p = root.children[0]
    assert p.tag == "p" and p.children[0].tag == "b" and [c if isinstance(c, str) else c.tag for c in p.children[0].children] == ["a", "p", "c"]
    assert [b["text"] for b in Reader("<p><b>a<p>b</p></i>c").blocks] == ["a", "b", "c"]


def test_metrics_and_columns(spark):
    m = metrics(parse(PAGE))
    assert (m["headings"], m["paragraphs"], m["items"], m["lists"], m["cells"], m["images"], m["internal_links"], m["hyperlinks"]) == (1, 2, 5, 4, 3, 2, 1, 1)
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id long, html string")
    rows = {r.id: r.d for r in df.select("id", read_html(df.html, "title", "ids", "metrics", "blocks").alias("d")).collect()}
    assert rows[1].title == "T" and rows[1].ids == ["top1"] and len(rows[1].blocks) > 10
    assert rows[2].title is None and rows[2].blocks is None and rows[3].blocks == []


@pytest.mark.parametrize("tag", ["b", "div", "p", "ul", "span", "x-y", "a href='#t'", "sup"])
def test_deep_nesting(tag):
    name = tag.split()[0]
    html = "<style>b b{color:red} * > div{color:blue} x-y ~ p{color:green}</style>" + f"<{tag}>" * 100_000 + "deep" + f"</{name}>" * 50_000 + "</i>" * 50_000 + " after"
    began = time.perf_counter()
    r = Reader(html)
    assert "".join(b["text"] for b in r.blocks).split() in (["deep", "after"], ["deepafter"], []) and metrics(r.root)["characters"] > 8
    assert time.perf_counter() - began < 60


def test_a_reader_that_fails_is_an_issue(spark, monkeypatch):
    nested = "<ul><li>" * 3000 + "x"
    df = spark.createDataFrame([(1, nested), (2, "<p>fine</p>")], "id long, html string")
    rows = {r.id: r.d for r in df.select("id", read_html(df.html, "blocks", "issues").alias("d")).collect()}
    assert rows[2].blocks[0].text == "fine" and len(rows[1].blocks) >= 1
    monkeypatch.setattr("quire.sources.html.Reader", lambda h: 1 / 0)
    from quire.sources.html import _read

    assert _read("<p>x</p>", ("blocks", "issues")) == {"blocks": None, "issues": [{"code": "fault", "message": "ZeroDivisionError"}]}


def test_bits_agree_with_trying_every_selector():
    import random

    draw = random.Random(3)
    tags, classes = ["div", "p", "b"], ["x", "y"]
    for _ in range(30):
        html, opened = "", []
        for _ in range(60):
            if opened and draw.random() < 0.45:
                html += f"</{opened.pop()}>"
            else:
                t = draw.choice(tags)
                ident = f' id="i{draw.randrange(4)}"' if draw.random() < 0.2 else ""
                html += f'<{t} class="{" ".join(draw.sample(classes, draw.randint(0, 2)))}"{ident}>t'
                opened.append(t)
        root = parse(html)
        one = lambda: draw.choice(["div", "p", "b", ".x", ".y", "*", "#i1", "p.x", "b:first-child", "[class~=y]", "p:last-child"])
        heads = [one() + "".join(draw.choice([" ", ">", "+", "~"]) + one() for _ in range(draw.randint(0, 3))) for _ in range(12)]
        cascade = Cascade([f"{h}{{color:c{i}}}" for i, h in enumerate(heads)])
        selectors = [parse_selector(h) for h in heads]
        for n in root.walk():
            if n.tag:
                cascade.style(n)
                got = {cascade._last[k][0][2] for k in cascade._matched(n)}
                assert got == {f"c{i}" for i, s in enumerate(selectors) if s.fits(n)}
