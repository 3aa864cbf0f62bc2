import html as H
import random
import re
import time

import numpy as np

from tidelane.llm import page_text as P

TEXT = "The council met on Tuesday to discuss the harbour, and most of its members spoke for an hour or more."
MORE = "Nobody had expected so many people to come; chairs were brought from the school next door."


def page(body, head="<title>News</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_parts_that_are_never_main_text():
    body = f"""
    <header class="site"><a href="/">Home</a> Our paper of record since 1900, read by everyone in town</header>
    <nav><ul><li><a href="/a">News</a><li><a href="/b">Sport</a></ul></nav>
    <div class="cookie-notice">We use cookies to make this page better for you and for all of our partners. <button>Yes</button></div>
    <div id="sidebar-left"><p>Weather: rain, and more of it, with winds from the west turning to the north at night.</p></div>
    <aside><p>Most read: a long headline of an article that isn't this one, and a bit of its text too.</p></aside>
    <article class="post has-image">
      <header><h1>Harbour &amp; town</h1></header>
      <p>{TEXT}</p>
      <div class="ad">Buy now, pay later, and never think about it again until the bill comes in the post.</div>
      <p>Short.</p>
      <script>if (a < b) document.write("<p>no</p>");</script><style>p {{ color: red }}</style>
      <form><label>Mail</label><input name=q><p>Leave your address here and we will send you a letter each day.</p></form>
      <ul><li>First point</li><li>Second&nbsp; point</li></ul>
      <p>{MORE}</p>
      <section id="comments"><article class="comment"><p>{TEXT} I say no to all of that, as I did before.</p></article></section>
      <footer>Tags: harbour, council, and a lot of other things that nobody ever reads</footer>
    </article>
    <div role="complementary"><p>{MORE}</p></div>
    <div hidden><p>{TEXT}</p></div>
    <footer><p>&copy; Our paper. All the rights that there are, and some more that we made up ourselves.</p></footer>"""
    assert P.main_text(page(body)) == "\n".join(["Harbour & town", TEXT, "Short.", "First point", "Second point", MORE])


def test_pages_without_article():
    """The element that holds the core is found by ratios; a menu without a name goes for its links."""
    menu = "".join(f'<li><a href="/{i}">Entry number {i}</a></li>' for i in range(12))
    body = f"<div><ul>{menu}</ul></div><div><div><h2>Harbour</h2><p>{TEXT}</p><p>Yes.</p><p>{MORE}</p></div></div><div><a href='/x'>Next</a> | <a href='/y'>Last</a></div>"
    assert P.main_text(page(body)) == "\n".join(["Harbour", TEXT, "Yes.", MORE])
    # Names that would drop all are not believed where nothing else is left.
    assert P.main_text(page(f"<div class='page-with-sidebar'><p>{TEXT}</p></div>")) == TEXT
    assert P.main_text(f"{TEXT}\n\n{MORE}") == f"{TEXT} {MORE}"


def test_broken_pages():
    assert P.main_text(f"<head><title>x</title><p>{TEXT}<p>{MORE}") == f"{TEXT}\n{MORE}"
    assert P.main_text(page(f"<form action=/><div><article><p>{TEXT}</article></div></form>")) == TEXT
    assert P.main_text(page(f"<nav><a>x</a><main><p>{TEXT}</main>")) == TEXT
    assert P.main_text(f"<article><p>{TEXT}</p><p>{MORE}</p><a href='") == f"{TEXT}\n{MORE}"
    assert P.main_text(f"<article><p>{TEXT} &amp; &#233;&eacute;&am</article><!-- open <p>{MORE}") == f"{TEXT} & éé&am"
    assert P.main_text(page(f"<article><p><b>{TEXT}<br>{MORE}<br><p>x</b> y</article>")) == f"{TEXT} {MORE}\nx y"
    assert P.main_text(page(f"<article><p>{TEXT} <span class='ad'>Buy!</span> {MORE}</article>")) == f"{TEXT} {MORE}"
    assert P.main_text("<article></article><div class=ad>Only an advert is here, and it isn't text.</div>") == ""
    assert [P.main_text(x) for x in ("", "<", "<p", "</p>", "<![x", "&", "<script>var a")] == ["", "<", "", "", "", "&", ""]


def test_articles_by_their_core():
    """Of several articles those with a core line stay, whole."""
    teasers = "".join(f"<article><a href=/{i}><h3>Read this {i}</h3></a></article>" for i in range(8))
    assert P.main_text(page(f"{teasers}<article><h1>A</h1><p>{TEXT}</p><p>B</p></article>")) == f"A\n{TEXT}\nB"


def test_smoothing_and_threshold():
    ratio = np.array([0.0, 0, 0, 90, 5, 80, 100, 0, 0, 0, 0, 0])
    level = P.smoothed(ratio)
    weights = np.exp(-0.5 * (np.arange(12)[:, None] - np.arange(12)) ** 2) * (abs(np.arange(12)[:, None] - np.arange(12)) <= 3)
    assert np.allclose(level, (weights * ratio).sum(1) / weights.sum(1))
    assert np.allclose(P.smoothed(np.full(5, 7.0)), 7)
    # The short line between long ones is in their cluster.
    assert P.core_lines(ratio).tolist() == (level >= level.std()).tolist() and P.core_lines(ratio)[3:7].all()
    assert not P.core_lines(ratio)[[0, 10, 11]].any() and not P.core_lines(np.zeros(3)).any()


def test_odd_markup_ends_soon():
    r = random.Random(1)
    bits = ["<p>", "</p>", "<div>", "<", "<!", "<![foo", "<!--", "-->", "]]>", "&", "&#x", "<a href='", "'>", "<b", "/>", "<script>", "<?", "text ", "<td class=ad"]
    bits += ["<li>", "</", "<article>", "<main>", "</article>", "<form>", "\0", "é", "<head>", "<body>", "<textarea>", "<svg>", "<tr>"]
    for _ in range(3000):
        P.main_text("".join(r.choice(bits) for _ in range(r.randint(0, 25))))
    began = time.process_time()
    for x in ("<div>", "<", "&", "<!--", "<a href='", "<p>", "<![", "<?", "<b>x</i>", "<script></scrip"):
        P.main_text(x * 20_000)
    assert time.process_time() - began < 30


def test_tables(spark, tmp_path):
    import __spark_entry__

    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (3, page(f"<article><p>{TEXT}</article>"), 5, None), (None, "<p>a", 6, "y")]
    rows += [rows[2], (4, page("<article>" + f"<p>{TEXT}</p>" * 5000 + "</article>"), 1, "z")]
    pages = spark.createDataFrame(rows, "page_id long, html string, n_chars int, `a.b` string")
    out = P.extracted(pages).collect()
    assert sorted(map(str, ((r.page_id, r["a.b"], r.text) for r in out))) == sorted(map(str, ((i, s, P.main_text(h or "")) for i, h, _, s in rows)))
    assert all(r.n_chars == len(r.text) for r in out) and max(r.n_chars for r in out) == 5000 * (len(TEXT) + 1) - 1
    assert P.extracted(spark.createDataFrame([], "page_id long, html string")).collect() == []
    # The whole table: its articles have plain paragraphs, which a few patterns find too.
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want[r.page_id] = (r.url, "\n".join(b for b in blocks if b))
    got = {r.page_id: (r.url, r.text) for r in __spark_entry__.queries()["op12_page_text"](spark, sf).collect()}
    assert got == want and want
