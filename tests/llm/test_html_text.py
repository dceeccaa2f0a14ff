import math

import pytest

from tessella.llm import html_text as h

from .helpers import with_clashes

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<!-- ad <p>no</p> --><div class="ad">Buy</div><header>Site</header><article><header><h1>Title &amp; more</h1></header><p><b>First  part<br>second.<p>Two&nbsp;x &lt;i&gt;</p>
<form><input><p>mail</p></form><aside>Side</aside><div class="share-buttons">Share</div><ul><li>one<li>two</ul><section id="comments"><p>me</p></section></article><footer>F</footer></body></html>"""


@pytest.mark.parametrize("source, want", [
    (PAGE, ["Title & more", "First part second.", "Two x <i>", "one", "two"]),
    ("<main><h1>A</h1><article><p>b</p></article><div class='related'><article>c</article></div></main>", ["A", "b"]),
    ("<div class='cookie-notice'>n</div><div class='has-sidebar'>k</div>", ["k"]),
    ("<p>a<table><tr><td>b<td>c<tr><td>d</table>e", ["a", "b c", "d", "e"]),
    ("<p hidden>no</p><p class='visually-hidden'>no</p><div class='topnav'>no</div><p title='a hidden b'>yes</p>", ["yes"]),
    ("<p title=\"a>b\">x</p><p title='unclosed>y</p>", ["x", "y"]),
    ("plain &eacute;&#233;&#xe9 text", ["plain ééé text"]),
    ("<div class='comments'>only</div>", ["only"]), ("", []), (None, []), ("<script>x", []), ("<!-- open", []), ("<p>" * 3000 + "x", ["x"]),
    ("a <b>bo</b>ld <i>w</i>ord", ["a bold word"]),
])
def test_lines(source, want):
    assert [x for x, _ in h.page_lines(source)[0]] == want


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in "ab")
        at = h.common_lines(a, b, rng.choice([4, 10**9]))
        assert at == sorted(set(at)) and len(at) == plain_lcs(a, b)
        rest = iter(b)
        assert all(any(a[i] == x for x in rest) for i in at)


def page(body):
    return f"<html><body><div>Welcome to the site</div><div>Latest offers today</div>{body}<div>All rights of the site</div></body></html>"


def test_differencing(spark):
    rows = [
        (1, "http://a.com/x/1", page("<p>Story number one is told here</p>")), (2, "http://a.com/x/2", page("<p>Another tale with other words</p>")), (3, "http://b.com/x/1", page("<p>Alone on its host</p>")),
        (4, "http://c.com/1", page("<p>Copy</p>")), (5, "http://c.com/2", page("<p>Copy</p>")), (6, "http://d.com/", PAGE), (7, "http://d.com/2", PAGE), (8, None, None), (1, "http://a.com/x/1", page("<p>Story number one is told here</p>")),
        (9, "http://e.com/1", "<p>Long shared story of the page " + "x " * 200 + "</p><p>a1</p>"), (10, "http://e.com/2", "<p>Long shared story of the page " + "x " * 200 + "</p><p>a2</p>"),
    ]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"), "rid", "host", "deleted", "text")
    whole = "Welcome to the site\nLatest offers today\n{}\nAll rights of the site"
    want = {1: "Story number one is told here", 2: "Another tale with other words", 3: whole.format("Alone on its host"), 4: whole.format("Copy"), 5: whole.format("Copy"), 8: ""}
    for limit in (100, 0):
        got = h.extract(pages, broadcast_rows=limit).collect()
        assert len(got) == len(rows)
        by = {r["page_id"]: r["text"] for r in got}
        assert {k: by[k] for k in want} == want and by[6] == by[7] and by[9].endswith("a1") and by[9].startswith("Long")
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert h.extract(pages.limit(0)).collect() == []


def versions(n, story):
    return [story + " It goes on for a good while, in words that all versions have in common." + f"</p><p>seen {k}" for k in range(n)]


def test_runs_of_versions_find_the_next_other_page(spark):
    """Copies and versions of a page, however many, are differenced against the nearest page that is none."""
    bodies = [f"<p>{x}</p>" for x in ["Copied story of some length"] * 7 + versions(9, "Versioned story of quite some length.") + ["A last story that has words of its own, more than the frame"]]
    rows = [(i, f"http://a.com/s/{i:03}?p={i}", page(b)) for i, b in enumerate(bodies)]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all("Welcome" not in r["text"] and "offers" not in r["text"] and "rights" not in r["text"] for r in got)
    assert all("tory" in r["text"] for r in got)
    assert {r["text"] for r in got if r["page_id"] < 7} == {"Copied story of some length"}
    assert sum("seen" in r["text"] for r in got) == 9


def test_only_versions_between(spark):
    """The search goes on behind a run whose end is a version of the asking page although the pages between are not."""
    story = "<p>" + "A story long enough to outweigh the frame, told once more. " * 3 + "</p>"
    rows = [(1, "http://a.com/1", page(story + "<p>a</p>")), (2, "http://a.com/2", page(story + "<p>b</p>")), (3, "http://a.com/3", page("<p>Something else is told on this one</p>"))]
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].split("\n")[-1] == "a" and got[2].split("\n")[-1] == "b" and got[3] == "Something else is told on this one" and "Welcome" not in got[1] + got[2]


@pytest.mark.parametrize("n", [9, 33, 330])
def test_rounds_are_logarithmic(spark, monkeypatch, n):
    """Pages whose text is a part of every other page of their host: of none decides one, however many there are."""
    frame = "<div>Frame of the place</div><div>Of all its pages</div>"
    rows = [(i, f"http://a.com/{i:05}", f"<body>{frame}<div>Page {i} has words of its own, and more than the frame has</div></body>") for i in range(n)]
    rows += [(n, "http://a.com/00001b", f"<body>{frame}</body>"), (n + 1, "http://b.com/x", f"<body>{frame}</body>")]
    rounds, write = [], h.written

    def counted(df, name):
        rounds.append(name == "differences")
        return write(df, name)

    monkeypatch.setattr(h, "written", counted)
    got = sorted((r["page_id"], r["text"]) for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == brute_force(rows)[0] and sum(rounds) <= 2 + math.log2(n)


def test_marks_protect_and_differencing_decides(spark):
    """Within marked articles, lines in containers of unlisted names vanish only since the nearest page has them; plain ones stay."""
    article = "<article><h1>{0}</h1><p>A passage that both articles have</p><div class='zq-17'>Read our other stuff<p>Call now</p></div><p>Own words of {0}</p><div class='zq-18'>Only {0}</div></article>"
    rows = [(i, f"http://a.com/{i}", f"<body><div>Frame</div>{article.format(x)}</body>") for i, x in enumerate(["one", "two"])] + [(7, "http://b.com/", f"<body><div>Frame</div>{article.format('alone')}</body>")]
    got = {r["page_id"]: r["text"].split("\n") for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ["one", "A passage that both articles have", "Own words of one", "Only one"] and got[1] == ["two", "A passage that both articles have", "Own words of two", "Only two"]
    assert got[7] == ["alone", "A passage that both articles have", "Read our other stuff", "Call now", "Own words of alone", "Only alone"]


def brute_force(rows):
    """The texts of (page_id, url, html), page after page."""
    import os.path
    import re

    hosts = {}
    for _, url, source in rows:
        host, path = (re.sub(r"^[a-z]+://", "", url or "").split("/", 1) + [""])[:2]
        path = re.split(r"[?#]", path)[0].strip("/")
        lines, body, _ = h._body(source)
        kept = tuple((x.text, b, x.plain and b) for x, b in zip(lines, body))
        mine = hosts.setdefault(host, {})
        mine[kept] = min(mine.get(kept, path), path)
    out, changed = [], 0
    for i, url, source in rows:
        lines, body, marked = h._body(source)
        kept = tuple((x.text, b, x.plain and b) for x, b in zip(lines, body))
        mine = hosts[re.sub(r"^[a-z]+://", "", url or "").split("/", 1)[0]]
        own = mine[kept]
        total = sum(len(x) for x, b, _ in kept if b)
        near = sorted((o for o in mine if o != kept), key=lambda o: -len(os.path.commonprefix([own, mine[o]])))
        at = []
        for o in near:
            at = h.common_lines([x for x, *_ in kept], [x for x, *_ in o])
            if sum(len(kept[k][0]) for k in at if kept[k][1]) <= 0.8 * total:
                break
            at = []
        changed += any(not kept[k][2] for k in at)
        out.append((i, "\n".join(x for k, (x, b, p) in enumerate(kept) if b and (p or k not in at) and (marked or lines[k].linked < len(x.replace(" ", ""))))))
    return sorted(out), changed


def test_as_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want, _ = brute_force([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert sorted((r["page_id"], r["text"]) for r in h.extract(pages).collect()) == want
