import random
import re
from collections import Counter, defaultdict

from furrow.llm.site_templates import main_texts, parse_page, read_page

SCHEMA = "page_id long, url string, html string, text string, host string"


def blocks(html):
    return [b for b, _ in read_page(html)]


def test_only_the_article_is_read():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="ad-free">
    <header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies</div><aside>Side</aside>
    <!-- <p>no</p> --><script>var t="</p><p>x";</script><article><header><h1>Head&nbsp; line</h1></header><p>One &amp; <b>two<br>three<p>Four
    <span class="ad">Buy</span> &#233;&eacute; a < b</p><form><p>Mail</p></form><div id="comments"><p>First!</p></div>
    <ul><li>L1<li>L2</ul><table><tr><td>c1<td>c2</table></article><section class="comments"><article class="comment">me too</article></section>
    <footer>&copy; x</footer></body></html>"""
    assert blocks(html) == ["Head line", "One & two three", "Four éé a < b", "L1", "L2", "c1", "c2"]


def test_broken_pages_give_what_they_hold():
    assert blocks("") == [] and blocks("plain &lt;text&gt;") == ["plain <text>"]
    assert blocks("<p>a<p>b<div>c</p>d") == ["a", "b", "c", "d"]
    assert blocks("<article><p>cut") == ["cut"]
    assert blocks("<p title=\"a>b\">x</p><p title='open>y</p>") == ["x", "y"]
    assert blocks("<script>never closed <p>x") == []
    assert blocks("<main><p>m</p></main><p>out</p>") == ["m"]
    assert len(blocks("<div>" * 3000 + "deep")) == 1


def test_names_are_whole_words_and_give_way_to_articles():
    article = """<article><h2 id="related-work">Related work</h2><section id="search-algorithms"><h2 id="comments">On comments</h2><p>Found</p></section>
    <div class="client-side-rendering">Client</div><div id="social-impact">Impact</div><aside>Quote</aside><div class="related">More</div><div class="ads">Buy</div></article>"""
    inside = ["Related work", "On comments", "Found", "Client", "Impact", "Quote", "More"]
    assert blocks(article) == inside
    assert blocks(f'<div class="content has-sidebar">{article}</div>') == inside
    assert blocks(f'<form><div class="sidebar content-with-sidebar">{article}</div></form>') == inside
    assert blocks('<div class="content-with-sidebar"><p>a</p></div><div class="left-sidebar">no</div><div id="cookie-banner">no</div><div class="site-footer">no</div>') == ["a"]
    assert blocks('<div id="comments"><article>me too</article></div><p>x</p>') == ["x"]


def test_template_of_a_host_goes_but_articles_stay(spark):
    rows = []
    for i in range(30):
        plain = f"<div><p>Top bar</p></div><div><p>Text {i}</p><p>Same words</p></div><div><ul><li>Join us</ul></div>"
        rows.append((i, "http://a.example/x", plain, "c", "c"))
        story = f"<article><h1>T{i}</h1><p>Licence</p><div><p>Follow us</p></div></article>"
        rows.append((100 + i, "https://B.example:80/y", story, "c", "c"))
    rows += [(200, None, None, None, None), (None, "nohost", "<p>x</p>", None, None), (201, "http://c.example", "<p>once</p>", None, None)]
    rows += [(201, "http://c.example", "<p>once</p>", None, None)] * 9
    got = Counter((r.page_id, r.text) for r in main_texts(spark.createDataFrame(rows, SCHEMA)).collect())
    # "Same words" recurs on every page outside an article, so it is template there; a licence line inside articles is not.
    want = Counter({(200, ""): 1, (None, "x"): 1, (201, "once"): 10})
    want.update({(i, f"Text {i}"): 1 for i in range(30)})
    want.update({(100 + i, f"T{i}\n\nLicence"): 1 for i in range(30)})
    assert got == want
    assert main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_count_once_and_sections_of_large_hosts_are_found(spark):
    rows = []
    for i in range(12):
        # Copies that differ in an id, an advert and a script; the text is not template.
        copied = f'<div id="a{i}"><script>track({i})</script><div class="ad">Buy {i}</div><p>Told once</p><p>Told twice</p></div><div><p>Top bar</p></div>'
        rows.append((i, "http://a.example/x", copied, "c", "c"))
        rows.append((100 + i, "http://a.example/y", f"<div><p>Other {i}</p></div><div><p>Top bar</p></div>", "c", "c"))
    for i in range(1500):
        bar = "<div><p>Section bar</p></div>" if i < 120 else ""
        rows.append((1000 + i, "http://b.example/z", f"<div><p>Text {i}</p></div>{bar}", "c", "c"))
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: "Told once\n\nTold twice" for i in range(12)} | {100 + i: f"Other {i}" for i in range(12)} | {1000 + i: f"Text {i}" for i in range(1500)}
    assert got == want


def test_story_beside_articles_stays_and_sidebars_go_on_every_host(spark):
    cards = "<article><p>Card</p></article>"
    assert blocks(f"<div><p>Story</p></div>{cards}") == ["Story", "Card"]
    assert blocks(f"<main><p>Story</p></main>{cards}<p>out</p>") == ["Story", "Card"]
    rows = []
    for i in range(60):
        side = f'<aside><p>Follow us</p></aside><div class="sidebar"><p>Note {i}</p></div><nav><p>Menu {i}</p></nav>'
        rows.append((i, "http://a.example/x", f"<div><p>Text {i}</p></div>{side}", "c", "c"))
    rows.append((100, "http://b.example/x", '<p>Text</p><div class="sidebar"><p>Note</p></div>', "c", "c"))
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Text {i}" for i in range(60)} | {100: "Text"}


def test_inline_elements_end_with_their_own_tag():
    assert blocks('<p>a <span class="ad"><span>Buy</span> now</span>b</p>') == ["a b"]
    assert blocks('<p>a <span hidden>x <b>y</b> <span>z</span> w</span> b</p>') == ["a b"]
    assert blocks('<p>a <span class="ad"><span>Buy</span> now b</p><p>c</p>') == ["a now b", "c"]
    assert blocks('<p>a <span class="ad">open b</p>') == ["a open b"]
    many = "<p>" + '<span class="ad"><span>x</span>' * 3000 + "y</p>"
    assert blocks(many) == ["y"]


def test_comments_sidebars_and_notices_by_their_names():
    assert blocks('<p>x</p><div class="user-comments"><p>no</p></div><section id="discussion"><p>no</p></section><div class="reader-comments-list">no</div>') == ["x"]
    assert blocks('<article><p>x</p><div class="sidebar">no</div><div class="cookie-notice">no</div><div class="newsletter-signup">no</div><div class="share-buttons">no</div></article>') == ["x"]
    assert blocks('<div class="content social"><p>story</p></div><div class="social">no</div>') == ["story"]
    assert blocks('<article><h2>Discussion</h2><div class="discussion-of-results">kept</div></article>') == ["Discussion", "kept"]


def brute(rows):
    """Main texts by counting in plain Python."""
    pages = [(r[0], r[1], parse_page(r[2] or "")) for r in rows]
    host_of = lambda url: (re.match(r"^[A-Za-z][\w+.-]*://([^/?#:]*)", url or "") or [None, ""])[1].lower()
    contents, outside = defaultdict(set), defaultdict(set)
    for _, url, page in pages:
        contents[host_of(url)].add(page.content)
        for subtree, rest in page.subtrees:
            outside[host_of(url), subtree].add(rest)
    texts = []
    for page_id, url, page in pages:
        host = host_of(url)
        least = max(5, min(0.1 * len(contents[host]), 100))
        kept = [b for b, own in zip(page.blocks, page.owners) if not any(len(outside[host, o]) >= least for o in own)]
        texts.append((page_id, "\n\n".join(kept)))
    return texts


def test_texts_of_generated_hosts_equal_a_plain_count(spark):
    rng = random.Random(2)
    rows, lost, leaked = [], 0, Counter()
    want = {}
    for host, pages in (("a", 3), ("b", 12), ("c", 60)):
        bars = [f"{host} bar {k}" for k in range(4)]
        for i in range(pages):
            story = [f"{host} story {i} line {k}" for k in range(rng.randint(1, 5))]
            shape = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
            body = shape.format("".join(f"<p>{s}</p>" for s in story))
            top = "".join(f"<div><p>{b}</p></div>" for b in rng.sample(bars, 2))
            side = f'<aside>{i} aside</aside><div class="sidebar">{i} side</div><div class="user-comments"><p>{i} said</p></div>'
            page = len(rows)
            rows.append((page, f"http://{host}.example/{i}", f"<body><header>H</header>{top}{body}{side}<footer>F</footer></body>", "c", "c"))
            want[page] = "\n\n".join(story)
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == dict(brute(rows))
    for page, text in want.items():
        story, found = set(text.split("\n\n")), set(got[page].split("\n\n"))
        lost += len(story - found)
        leaked[text[0]] += len(found - story)
    # Bars stay only where a host has too few pages to count on.
    assert lost == 0 and leaked["c"] == 0 and leaked["b"] < 2 * 12 and leaked["a"] <= 2 * 3
