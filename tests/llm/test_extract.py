import html
import random
import re

from helpers import rows_of
from litsieve.llm import extract
from litsieve.session import read_table


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        at = extract.shared_lines(a, b)
        assert at == sorted(set(at)) and len(at) == plain_lcs(a, b)
        rest = iter(b)
        assert all(any(a[i] == x for x in rest) for i in at)


def text(page, *neighbours):
    form = lambda h: ([x for x, _ in extract.lines_of(h)], [k for _, k in extract.lines_of(h)], [x for x, k in extract.lines_of(h) if k != extract.NOISE])
    return extract.article_of(form(page), [form(n) for n in neighbours])


def test_named_parts_go():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice">We use cookies</div><aside>side</aside>
    <main><article><header><h1>A &amp; B</h1></header><p>One <b>bold</b>
    line&nbsp;here &lt;x&gt;<p>Two<br>three<div class="ad-box">Buy</div><form><input><button>Go</button></form>
    <ul><li>first<li>second</ul><script>var t="</p>";</script><table><tr><td>c1<td>c2</table>
    <pre>  code   here</pre></article><section class="Comments"><article class="comment"><p>nice!</p></article></section></main>
    <footer>&copy; me</footer></body></html>"""
    assert text(page) == "A & B\nOne bold line here <x>\nTwo three\nfirst\nsecond\nc1\nc2\ncode here"


def test_shared_lines_go_without_an_article():
    page = lambda x, y: f"<body><div>Menu one</div><div>Menu two</div><p>{x} is a long story about things</p><p>{y} and more of it here</p><div>Terms</div>"
    a, b, c = page("Ann", "Bob"), page("Cid", "Dan"), page("Eve", "Fay")
    assert text(a, b, c) == "Ann is a long story about things\nBob and more of it here"
    assert text(a, a, c) == text(a, c) == "Ann is a long story about things\nBob and more of it here"   # a copy is no template
    assert text(a).startswith("Menu one")                                                              # no neighbour, no template
    assert text(f"<article>{a[6:]}</article>", b) == text(a)


def test_broken_markup():
    assert text("<p>a<!-- open") == "a" and text("<p>a</p><p>b <im") == "a\nb" and text("x < y &am") == "x < y &am"
    assert text(None) == text("") == text("   ") == "" and text("<div class=ad>gone<p>too</div><p>kept") == "kept"
    assert text('<a title="x>y">t</a>') == "t" and text("<p>1<script>if (a<b) {}") == "1"


def plain_pages(page):
    """The one structure of the given pages."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", inner.group(1)) if inner else []
    clean = [" ".join(html.unescape(re.sub(r"<[^>]*>?", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in parts]
    return "\n".join(x for x in clean if x)


def test_given_pages(spark):
    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    rows = {r["page_id"]: r for r in rows_of(extract.main_text(pages))}
    given = rows_of(pages)
    assert len(rows) == len(given)
    for p in given:
        r = rows[p["page_id"]]
        assert r["text"] == plain_pages(p["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    rows = []
    for i in range(300):
        body = "".join(f"<p>{' '.join(rng.choices(words, k=12))}</p>" for _ in range(rng.randint(1, 4)))
        rows.append((i, f"http://h{i % 3 and 1}.org/{i // 7}/{i}", f"<div>Menu {i % 3 and 1}</div>{body}<div>Imprint</div>"))
    rows += [(None, None, None), (400, None, "<p>x</p>"), (5, rows[5][1], rows[5][2]), (401, "http://h1.org/0", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "'s' as range")
    first = sorted(map(str, rows_of(extract.main_text(pages.repartition(1)))))
    assert first == sorted(map(str, rows_of(extract.main_text(pages.repartition(13)))))
    assert len(first) == len(rows) and not any("Menu" in x or "Imprint" in x for x in first)
    assert extract.main_text(pages.where("page_id < 0")).count() == 0


def test_class_parts_do_not_name_noise():
    body = "<article><div class='entry-header'><h1>Title</h1></div><p>A long story about things</p></article>"
    for wrap in ('class="content has-sidebar"', 'class="layout with-header"', 'id="page-banner-wrap"', 'class="header-wrap"'):
        assert text(f"<body><div {wrap}>{body}</div>") == "Title\nA long story about things", wrap
    assert text(f"<div class='sidebar'><p>{'word ' * 40}</p></div><p>end</p>").startswith("word")   # most of the text


def test_alignment_decides_beside_and_inside_an_article():
    page = lambda x: f"<div>Menu one</div><p>{x} has the body in a plain part</p><article><p>{x} is on a card of its own</p></article>"
    a, b, c = page("Ann"), page("Bob"), page("Cid")
    assert text(a, b) == "Ann has the body in a plain part\nAnn is on a card of its own"
    assert text("<div class='side-bar'>x</div><div class='sidebar'>y</div><article><p>z</p></article>") == "x\nz"
    main = lambda x: f"<main><p>Home of things</p><p>{x} is a long story about other things</p><p>Terms</p></main>"
    a, b, c = main("Ann"), main("Bob"), main("Cid")
    assert text(a, b, c) == "Ann is a long story about other things"
    assert text(a, b) == text(a, b, a) == "Home of things\nAnn is a long story about other things\nTerms"   # one neighbour is not enough
    assert text(a, a.replace("Terms", "Term"), a.replace("Home", "House")) == text(a, b)                     # near copies
    heavy = lambda x: "".join(f"<p>Menu line {i}</p>" for i in range(9)) + f"<p>{x} is a story about some things</p>"
    assert text(heavy("Ann"), heavy("Bob"), heavy("Cid")) == "Ann is a story about some things"


def test_copies_are_passed_over_whatever_the_ranges(spark):
    page = lambda x: f"<div>Menu one</div><p>{x} is a long story about things</p><div>Terms</div>"
    rows = [(i, f"http://a.org/{i:04d}", page("Ann" if 100 <= i < 300 else f"No {i}")) for i in range(400)]
    rows.append((400, "http://b.org/1", page("Ann")))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in rows_of(extract.main_text(pages.repartition(7)))}
    assert len(got) == 401 and got.pop(400).startswith("Menu one")
    assert got == {i: f"{'Ann' if 100 <= i < 300 else f'No {i}'} is a long story about things" for i in got}


def test_names_said_first_or_last():
    story = "<p>A long story about things that go on</p>"
    for name in ("comment-list", "post-comments", "related-posts", "share-buttons", "ad-slot", "advert-unit", "cookie-bar", "commentList", "site-footer",
                 "main-menu", "ad-slot-2 x"):
        part = f"<div class='{name}'><p>gone</p></div>"
        assert text(f"<article><h1>T</h1>{story}{part}</article>") == "T\nA long story about things that go on", name
        assert text(f"<article><h1>T</h1>{story}</article>{part}<p>own line</p>") == "T\nA long story about things that go on\nown line", name
        assert text(f"<article><h1>T</h1></article><div id='{name}'>{'<p>nice words</p>' * 90}</div>") == "T", name   # an article elsewhere
    for name in ("content has-sidebar", "no-comments", "entry-header", "adhoc-notes", "related-work", "social-science", "comment-on-the-law", "page-title"):
        assert text(f"<body><p>x</p><p>{'word ' * 40}</p><div class='{name}'>{story}</div>").endswith("go on"), name


def test_shared_lines_within_an_article_stay():
    page = lambda x: f"<article><p>Series of notes</p><p>{x} begins a story of some length</p><p>The motto of all</p><p>{x} ends it here at last</p><p>Join us</p></article>"
    assert text(page("Ann"), page("Bob"), page("Cid")) == "Ann begins a story of some length\nThe motto of all\nAnn ends it here at last"
    assert extract.edges([1, 3, 5, 7], {1, 5, 7}) == {1, 5, 7} and extract.edges([1, 3, 5, 7], {1, 5}) == {1} and extract.edges([2], {2}) == {2}
