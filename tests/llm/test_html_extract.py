import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import html_extract as he

SCHEMA = "page_id long, url string, html string, lines string, uid string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()}


def test_article_alone_is_the_text():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
      <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
      <article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>two<br>three.<p>Four&nbsp;&eacute;&#33;
      <aside>side</aside><form><input value=x>send</form><div class="share-bar">Tweet</div><ul><li>a<li>b</ul><section id="comments"><p>first!</p></section></article>
      <footer>&copy; us</footer></body></html>"""
    main = [t for z, t in he.lines(page) if z == "main"]
    assert main == ["Title & more", "One boldtwo three.", "Four é!", "a", "b"]


def test_broken_markup():
    assert he.lines("<article><p><b>x &amp;&amp; y<br><p>z</p></article><footer>f") == [("main", "x && y"), ("main", "z"), ("chrome", "f")]
    assert he.lines("<p>a < b &unknown; <i>c") == [("open", "a < b &unknown; c")]
    assert he.lines("<script>never closed <article>x") == [] and he.lines("<!-- never closed <p>x") == [] and he.lines(None) == []
    assert he.lines("<article>x</div></section>y</article>z") == [("main", "xy"), ("open", "z")]
    assert he.lines('<div class="comment">a</div><p class="uncommented">b') == [("chrome", "a"), ("open", "b")]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_alignment_is_a_longest_common_subsequence(a, b):
    got = he.differenced(np.array(a, np.int64), np.array(b, np.int64))
    if a == b:
        assert got == []
        return
    assert got == sorted(set(got)) and len(got) == brute_lcs(a, b)
    rest = iter(b)
    assert all(any(x == y for y in rest) for x in (a[i] for i in got))


def site(host, n, body):
    return [(f"http://{host}/news/{i}", f"<div>Menu of {host}</div><p>{body} {i}</p><p>more {body} {i}</p><div>Imprint {host}</div>") for i in range(n)]


def test_differencing_against_the_nearest_url(spark):
    pages = [*site("a.example", 30, "alpha"), *site("b.example", 20, "beta"), ("http://c.example/x", "<p>alone</p>")]
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    got = texts(spark, rows)
    assert got[3] == "alpha 3 more alpha 3" and got[35] == "beta 5 more beta 5" and got[50] == "alone"


def test_pairs_do_not_depend_on_the_parts(spark):
    rng = np.random.default_rng(0)
    rows = [("h" if i % 3 else f"h{i % 7}", f"/{rng.integers(0, 50)}/{i}", i, i) for i in range(500)]
    frame = spark.createDataFrame(rows, "host string, path string, page_id long, uid long")
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found.append({tuple(r) for r in he.pairs(frame).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", keep)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = sorted(rows)
    want = set()
    for k, r in enumerate(order):
        near = [o for o in ([order[k - 1]] if k else []) + order[k + 1 : k + 2] if o[0] == r[0]]
        if near:
            want.add((r[3], max(near, key=lambda o: len(he.commonprefix([o[1], r[1]])))[3]))
    assert found[0] == found[1] == want


def test_copies_nulls_empty_and_repeated(spark):
    page = "<p>same</p><p>lines</p>"
    got = texts(spark, [(1, "http://a.example/1", page), (2, "http://a.example/2", page), (3, None, None), (4, "http://a.example/3", ""), (5, None, "<article>x</article>"), (5, None, "<article>x</article>"), (None, "u", "<p>" + "long " * 50_000)])
    assert got[1] == got[2] == "same lines" and got[3] == "" and got[4] == "" and got[5] == "x" and len(got[None]) == 249_999
    assert he.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    assert he.extract(spark.createDataFrame([(1, "u", "<article>x</article>", "", "")] * 2, SCHEMA)).count() == 2


def test_class_words_of_a_layout_empty_nothing(spark):
    pages = [
        '<article class="post has-sidebar"><p>Hello world</p></article>', '<div class="layout-with-sidebar"><article><p>Hello world</p></article></div>',
        '<article><h2 id="related-work">Related</h2><p class="social-history">Hello world</p></article>', '<article>x <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>a=2</annotation></math> y<noscript>z</noscript></article>',
        "<article>a<svg><g><svg><text>no</text></svg><text>tail</text></g></svg>b</article>", '<div class="siteNav">menu</div><div id="cookie-notice">c</div><main>m</main><div class="ad-300x250">ad</div>',
        "<article><p>teaser</p></article><div><p>the story itself is told at length here</p></div>", "<article><p>the story itself is told at length here</p></article><div>see also</div>",
    ]
    got = texts(spark, [(i, f"http://h{i}.example/x", p) for i, p in enumerate(pages)])
    assert [got[i] for i in range(8)] == ["Hello world", "Hello world", "Related Hello world", "x a=2 y z", "ab", "m", "teaser the story itself is told at length here", "the story itself is told at length here"]


def made(rng, host):
    """A page of random blocks, and its lines as (zone, text), known from its making."""
    word = lambda: "".join(rng.choice(list("abcdeé漢 ß"), int(rng.integers(1, 6)))).strip() or "w"

    def prose():
        shown, source = [], []
        for _ in range(int(rng.integers(1, 6))):
            w = " ".join(word().split())
            kind = int(rng.integers(6))
            shown.append(w + (" & <" if kind == 1 else ""))
            source.append([w, f"{w} &amp; &lt;", f"<b>{w}</b>", f"<!-- no {w} -->{w}", f"<a href='x>y'>{w}</a>", f"{w}<script>var no='</p>';</script>"][kind])
        return " ".join(" ".join(shown).split()), f"{rng.choice([' ', chr(10), '  '])}".join(source)

    lines, page = [], []

    def block(zone, shared=False):
        shown, source = (f"frame {host} {int(rng.integers(4))}",) * 2 if shared else prose()
        tag = rng.choice(["p", "div", "h2", "li", "section"])
        lines.append((zone, shown))
        page.append(f"<{tag}>{source}</{tag}>")

    def chrome():
        open_, close = [("<nav>", "</nav>"), ("<div class='ad'>", "</div>"), ("<footer>", "</footer>"), ("<div id=site-nav>", "</div>"), ("<form>", "</form>"), ("<section class='comments'>", "</section>"), ("<div hidden>", "</div>")][int(rng.integers(7))]
        page.append(open_)
        block("chrome")
        page.append(close)

    for _ in range(int(rng.integers(0, 4))):
        rng.choice([chrome, lambda: block("open"), lambda: block("open", True)])()
    if rng.random() < 0.5:
        page.append(rng.choice(["<article class='post with-sidebar'>", "<main>"]))
        end = "</article>" if "article" in page[-1] else "</main>"
        for _ in range(int(rng.integers(1, 5))):
            rng.choice([chrome, lambda: block("main"), lambda: block("main"), lambda: block("main", True)])()
        page.append(end)
    for _ in range(int(rng.integers(0, 4))):
        rng.choice([chrome, lambda: block("open"), lambda: block("open", True)])()
    return "<html><head><title>no</title><style>p{}</style></head><body>" + "".join(page) + "</body></html>", [x for x in lines if x[0] != "chrome"]


def test_texts_equal_the_definition_on_made_pages(spark):
    rng = np.random.default_rng(5)
    rows, known = [], {}
    for i in range(300):
        host = f"h{i % 3}.example"
        page, lines = made(rng, host)
        rows.append((i, f"http://{host}/{int(rng.integers(30)):02d}/{i}", page))
        known[i] = lines
    assert all([x for x in he.lines(page) if x[0] != "chrome"] == known[i] for i, _, page in rows)
    order = sorted((he.split_url(u), i) for i, u, _ in rows if any(z == "open" for z, _ in known[i]))
    want = {}
    for i, _, _ in rows:
        lines, shared = known[i], set()
        places = [k for k, (z, _) in enumerate(lines) if z == "open"]
        if places:
            at = next(k for k, (_, j) in enumerate(order) if j == i)
            near = [o for o in order[max(0, at - 1) : at] + order[at + 1 : at + 2] if o[0][0] == order[at][0][0]]
            other = max(near, key=lambda o: len(he.commonprefix([o[0][1], order[at][0][1]])))[1]
            ours, theirs = [lines[k][1] for k in places], [t for z, t in known[other] if z == "open"]
            number = {t: n for n, t in enumerate(dict.fromkeys(ours + theirs))}
            found = he.differenced(*(np.array([number[t] for t in x], np.int64) for x in (ours, theirs)))
            assert ours == theirs or len(found) == brute_lcs(ours, theirs)
            shared = {places[k] for k in found}
        left = [x for k, x in enumerate(lines) if k not in shared]
        main, open_ = (" ".join(t for z, t in left if z == zone) for zone in ("main", "open"))
        want[i] = main if main and len(main) >= len(open_) else " ".join(t for _, t in left)
    got = {r["page_id"]: r for r in he.extract(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=60), st.lists(st.integers(0, 9), max_size=60))
def test_halved_alignments_are_as_long(a, b):
    keep, he.CELLS = he.CELLS, 40
    try:
        got = he._aligned(np.array(a, np.int64), np.array(b, np.int64))
    finally:
        he.CELLS = keep
    rest = iter(b)
    assert len(got) == brute_lcs(a, b) and all(any(x == y for y in rest) for x in (a[i] for i in got))


def test_a_page_of_fifty_thousand_lines(spark):
    rng = np.random.default_rng(1)
    frame, own = [f"<li>entry {i}" for i in range(50_000)], set(rng.choice(50_000, 40, replace=False).tolist())
    page = "".join(f"<li>new {i}" if i in own else x for i, x in enumerate(frame))
    again = "".join(x for i, x in enumerate(frame) if i % 997)
    got = texts(spark, [(1, "http://a.example/1", f"<ul>{page}</ul>"), (2, "http://a.example/2", f"<ul>{again}</ul>")])
    missing = [f"entry {i}" for i in range(0, 50_000, 997) if i not in own]
    assert got[1].split("new") and sorted(f"{a} {b}" for a, b in zip(got[1].split()[::2], got[1].split()[1::2])) == sorted([f"new {i}" for i in own] + missing)
