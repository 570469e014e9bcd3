from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from stellate.llm import html_extract as hx
from tests.llm import awkward

PAGE = "page_id long, url string, html string"


def texts(spark, rows: list[tuple], **options) -> dict:
    got = hx.extract(spark.createDataFrame(rows, PAGE).selectExpr("*", "'x' AS host", "1 AS blocks", "2 AS part"), **options).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return {r["page_id"]: r["text"] for r in got}


def main_of(page: str) -> str:
    return " ".join(t for z, t in hx.blocks_of(page) if z == hx.MAIN)


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";x(0);</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- note <p>no</p> -->
    <div class="cookie-notice">We use cookies</div><div class='layout sidebar-left'><article class="post"><h1>Head &amp; line</h1>
    <p><b>First <i>para</i>graph.<br><p>Second&nbsp;&lt;one&gt;   with
    breaks.</p><div class="ad">Buy</div><form><input name=q><button>Go</button></form><aside>Side</aside><ul><li>One<li>Two</ul>
    <div class="share-buttons">Share</div><p>1 < 2 and 3 > 2</p></article></div>
    <section id="comments"><article class="comment"><p>Nice!</p></article></section><div class="ad">Ad</div><footer>&copy; me</footer></body></html>"""
    assert main_of(page) == "Head & line First paragraph. Second <one> with breaks. One Two 1 < 2 and 3 > 2"


def test_broken_markup():
    assert main_of("<article><p>open <b>bold <p>next") == "open bold next"
    assert main_of("<article>a<script>x<y</article>") == "a"
    assert main_of("<article>a<!-- never closed <p>b") == "a"
    assert main_of('<article>a<p class="x>b</p>c') in ("a c", "a b c", "a")
    assert main_of("<article>x</nav></div></article>") == "x"
    assert main_of("<main>a<main>b</main>c</main>d") == "a b c"
    assert hx.blocks_of("") == [] and hx.blocks_of("plain &amp; simple") == [(hx.OPEN, "plain & simple")]
    assert main_of("<article>" + "<div><p>deep " * 3000) == " ".join(["deep"] * 3000)


def test_articles_in_forms_and_headings_in_articles():
    body = "<h1>T</h1><p>Some text.</p>"
    assert main_of(f"<body><form><div><article>{body}</article></div><input><button>Go</button></form></body>") == "T Some text."
    assert main_of("<article><header><h1>T</h1></header><p>x</p><footer>by me</footer></article>") == "T x"
    assert main_of("<header><article><p>teaser</p></article></header><main><p>x</p></main>") == "x"
    open_form = "<html><body><form id='aspnet'><div><p>All of it.</p></div><select><option>a</select></form></body></html>"
    assert [t for z, t in hx.blocks_of(open_form) if z == hx.OPEN] == ["All of it."]
    assert main_of("<article><p>a</p><form><p>Your name</p></form></article>") == "a"


def test_hints_are_whole_names_or_their_ends():
    for name in ("with-header", "has-sidebar", "no-ads", "post-header", "content", "shadow", "headered", "adapt", "related_to_us"):
        kept = [t for z, t in hx.blocks_of(f'<div id="content" class="{name}"><p>x</p></div>') if z == hx.OPEN]
        assert kept == (["x"] if name != "related_to_us" else []), name
    for name in ("ad", "ad-box", "site-header", "cookie_notice", "main-nav", "post-share", "comments"):
        assert [z for z, _ in hx.blocks_of(f'<article><div class="wide {name}"><p>x</p></div></article>')] == [hx.CHROME], name


def test_formulas_drawings_and_fallbacks_are_text():
    assert main_of("<article><p>Let <math><mi>a</mi><mo>+</mo><mn>1</mn><annotation>TeX</annotation></math> be.</p></article>") == "Let a+1 be."
    assert main_of("<article><p>See <svg><style>x{}</style><text>axis</text><path d='M0'/></svg>!</p></article>") == "See axis!"
    assert main_of("<article><object data=x><p>instead</p></object></article>") == "instead"


def test_pages_without_an_article_lose_what_their_host_repeats(spark):
    shell = "<p>" + awkward.words(30, 1) + "</p>"
    rows = [(i, f"https://h.example/{i}", f"<body>{shell}<p>{awkward.words(40, 100 + i)}</p></body>") for i in range(6)]
    rows += [(9, "https://other.example/9", f"<body>{shell}<p>{awkward.words(40, 100)}</p></body>")]
    got = texts(spark, rows)
    assert [got[i] for i in range(6)] == [awkward.words(40, 100 + i) for i in range(6)]
    assert got[9] == awkward.words(30, 1) + " " + awkward.words(40, 100)


def test_copies_keep_their_text(spark):
    rows = [(i, "https://h.example/", f"<body><p>{awkward.words(60, 3)}</p></body>") for i in range(5)]
    rows += [(i, "https://h.example/", f"<article>{awkward.words(60, 4)}</article>") for i in range(5, 10)]
    got = texts(spark, rows)
    assert {got[i] for i in range(5)} == {awkward.words(60, 3)} and {got[i] for i in range(5, 10)} == {awkward.words(60, 4)}


def test_repeated_marks_exactly_the_runs():
    rng = np.random.default_rng(6)
    for _ in range(20):
        tokens = rng.integers(0, 3, 400)
        page = np.sort(rng.integers(0, 8, 400))
        host = page // 4
        for run in (1, 2, 5, 8):
            got = hx.repeated(tokens, page, host, run, 2)
            where: dict = {}
            for i in range(400 - run + 1):
                if page[i] == page[i + run - 1]:
                    where.setdefault((host[i], *tokens[i : i + run]), []).append(i)
            want = np.zeros(400, bool)
            for at in where.values():
                if len({page[i] for i in at}) >= 2:
                    for i in at:
                        want[i : i + run] = True
            assert (got == want).all()


def test_awkward_rows(spark):
    rows = [
        (1, "https://a.example/x", None), (2, None, "<p>text</p>"), (3, "not a url", ""), (None, None, None),
        (4, "https://a.example/y", "<article>" + "long " * 50000 + "</article>"), (4, "https://a.example/y", "<article>again</article>"),
    ]
    got = hx.extract(spark.createDataFrame(rows, PAGE)).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", 0), ("2", 4), ("3", 0), ("4", 5), ("4", 249999), ("None", 0)]
    assert hx.extract(spark.createDataFrame([], PAGE)).collect() == []


def test_large_hosts_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(hx, "PART_PAGES", 10)
    rows = [(i, f"https://h.example/{i}", f"<article>{awkward.words(20, i)}</article>") for i in range(60)]
    assert texts(spark, rows) == {i: awkward.words(20, i) for i in range(60)}


def on_a_host(n: int, repeats: int) -> list[tuple]:
    """Pages of one host, one in n / repeats of which holds the same 20 words."""
    shared = f"<p>{awkward.words(20, 1)}</p>"
    return [(i, f"https://h.example/{i}", f"<body>{shared if i % (n // repeats) == 0 else ''}<p>{awkward.words(15, 100 + i)}</p></body>") for i in range(n)]


def test_runs_are_found_across_a_whole_host(spark, monkeypatch):
    rows = on_a_host(900, 3) + [(1000 + i, f"https://two.example/{i}", f"<p>{awkward.words(20, 1)}</p>") for i in range(2)]
    got = {r["page_id"]: r["n_repeated"] for r in hx.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {i: 20 if i in (0, 300, 600) else 0 for i in [*range(900), 1000, 1001]}
    monkeypatch.setattr(hx, "PART_PAGES", 50)
    monkeypatch.setattr(hx, "BUCKET_RUNS", 1000)
    assert {r["page_id"]: r["n_repeated"] for r in hx.extract(spark.createDataFrame(rows, PAGE)).collect()} == got


def test_unique_runs_of_a_partly_repeated_block_stay(spark):
    shared, own = awkward.words(14, 1), [awkward.words(13, 100 + i) for i in range(4)]
    long = [awkward.words(40, 200 + i) for i in range(4)]
    rows = [(i, f"https://h.example/{i}", f"<div>{shared} {own[i]}</div><div>{long[i]} {shared}</div>") for i in range(4)]
    assert texts(spark, rows) == {i: f"{own[i]} {long[i]}" for i in range(4)}


def test_copies_of_a_row_spread_over_parts(monkeypatch):
    monkeypatch.setattr(hx, "PART_PAGES", 10)
    monkeypatch.setattr(hx.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    copy = {"page_id": None, "url": None, "host": "", "html": f"<article>{awkward.words(20, 1)}</article>"}
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("html", pa.string())])
    parts = list(hx._parts(pa.int64())([pa.RecordBatch.from_pylist([copy] * 95, kinds)]))
    assert [hx._read(p.column("pages")[0].as_py())[0].num_rows for p in parts] == [10] * 9 + [5]
