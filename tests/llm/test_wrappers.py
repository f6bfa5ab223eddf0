"""HTML extraction: texts of awkward pages, wrappers against brute force, and that wrappers decide what is text."""

import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("ampliref.llm")

from ampliref.llm import wrappers  # noqa: E402

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><div id="cookie-notice">We use cookies</div><nav>n</nav><div class="sidebar"><p>side</p></div>
<main><article><h1>Head &amp; line</h1><p>One <b>bo</b>ld<p>Two<br>three <a href=x>lin</a>k.<div class="advert">buy</div><form>f<input></form><script>var a="<p>no</p>";</script><!-- c <p>z</p> -->tail</article>
<section class="comments"><article class="comment">bad</article></section></main><footer>f</footer></body></html>"""
NAMES = """<article><div class="entry-header"><h1>Pills</h1></div><div class="side-effects">Nausea</div><ul class="menu-items-of-food"><li>Soup</li></ul><div class="cookieBanner">ok?</div></article>"""
SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    return {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(pages, SCHEMA)).collect()}


def test_pages(spark):
    rows = [(1, "http://h.org/a", PAGE), (2, "http://h.org/b", PAGE.replace("<p>One", "<p>x<p>One")), (3, None, None), (4, "http://k.org", "<div><h1>A</h1><p>b &lt;c&gt; &nbsp; d</div>"), (5, "bad", "plain"), (1, "http://h.org/a", PAGE), (None, "http://n.org", NAMES), (6, "http://m.org", "")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("text", "host", "wrapper", "common", "_host", "pages", "part")})
    got = [(r["page_id"], r["text"]) for r in wrappers.extract(pages).collect()]
    assert len(got) == len(rows)
    assert dict(got) == {1: "Head & line One bold Two three link. tail", 2: "Head & line x One bold Two three link. tail", 3: "", 4: "A b <c> d", 5: "plain", 6: "", None: "Pills Nausea Soup"}
    assert wrappers.extract(pages.limit(0)).count() == 0


def site(k, rnd):
    """A page without any telling name: a box, a list of links, a text of its own and a line that all pages have."""
    item = lambda: " ".join(rnd.choice("lorem ipsum dolor sit amet".split()) + str(rnd.randrange(99)) for _ in range(6))
    links = "".join(f"<li><a href=/{j}>{item()}</a></li>" for j in range(rnd.randrange(1, 5)))
    own = [item() for _ in range(rnd.randrange(1, 5))]
    extra = f"<blockquote>{item()}</blockquote>" if k % 3 == 0 else ""
    text = own + ([re.search(">(.*)<", extra)[1]] if extra else [])
    return f"<html><body><div class=x1>Sign up for our letters</div><ul>{links}</ul><div class=x2 id=post-{k}>{''.join(f'<p>{t}</p>' for t in own)}{extra}</div><div>All rights are ours, page by page</div></body></html>", " ".join(text)


def test_wrappers_decide(spark, monkeypatch):
    rnd = random.Random(5)
    made = [(k, f"http://s.org/{k}", *site(k, rnd)) for k in range(40)]
    want = {k: text for k, _, _, text in made}
    pages = [m[:3] for m in made]
    assert texts(spark, pages) == want
    # parts of a host, and rounds of them, give the same
    monkeypatch.setattr(wrappers, "PART_FORMS", 3)
    monkeypatch.setattr(wrappers, "PART_WRAPPERS", 2)
    monkeypatch.setattr(wrappers, "BROADCAST_CHARS", 0)
    assert texts(spark, pages) == want
    # another host's wrapper reads nothing of these pages, and none leaves them empty
    html_, common = pages[0][2], frozenset({wrappers._mark("c", "x1"), wrappers._mark("c", "x2")})
    assert wrappers.Reader(None).read(html_, common) == ""
    other, paths, _ = wrappers.form("<div class=x1>a</div><table><tr><td>b</td></tr></table>", common)
    assert wrappers.Reader(wrappers.dump(other, paths)).read(html_, common) != want[0]


def as_regex(nodes):
    def one(token):
        return f"(?:{''.join(map(one, wrappers.body(token)))})+" if token[0] == "(" else re.escape(token) + " "

    return re.compile("".join(f"(?:{one(n.token)})?" if n.optional else one(n.token) for n in nodes))


def test_wrapper_matches_every_page(monkeypatch):
    """Brute force: as a regular expression over unfolded streams, the wrapper matches all pages that it was made of."""
    rnd = random.Random(8)

    def tree(depth):
        tag = rnd.choice(["div", "p", "ul", "b", "table"])
        inner = "".join(tree(depth - 1) if depth and rnd.random() < 0.7 else rnd.choice(["x", "y", "<br>"]) for _ in range(rnd.randrange(4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        pages = ["<body>" + "".join(tree(2) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 9))]
        none = frozenset()
        wrapper = wrappers.form(pages[0], none)[0]
        for page in pages[1:]:
            wrapper = wrappers.align(wrapper, wrappers.form(page, none)[0])
        found = as_regex(wrapper)
        with monkeypatch.context() as m:
            m.setattr(wrappers, "fold", lambda nodes: nodes)
            streams = ["".join(n.token + " " for n in wrappers.form(page, none)[0]) for page in pages]
        assert all(found.fullmatch(s) for s in streams)


def test_folding_and_alignment():
    nodes = lambda s: [wrappers.Node(t) for t in s.split()]
    shown = lambda ns: [n.token + "?" * n.optional for n in ns]
    assert shown(wrappers.fold(nodes("ul li x /li li x /li li x /li /ul"))) == ["ul", "(li x /li)+", "/ul"]
    assert shown(wrappers.align(nodes("a b c"), nodes("a c d"))) == ["a", "b?", "c", "d?"]
    assert shown(wrappers.align(nodes("ul li x /li /ul"), wrappers.fold(nodes("ul li x /li li x /li /ul")))) == ["ul", "(li x /li)+", "/ul"]


def test_wrappers_do_not_grow_with_pages():
    """Identifiers and rare classes of pages leave no trace; forms of any length are aligned."""
    rnd = random.Random(2)
    wrapper, sizes = None, []
    for k in range(300):
        nodes, paths, _ = wrappers.form(f"<body class=p{k}>" + site(k, rnd)[0], frozenset())
        wrapper = nodes if wrapper is None else wrappers.align(wrapper, nodes)
        sizes.append(len(wrapper))
    assert sizes[-1] == sizes[50]
    long = "<article>" + "".join(f"<{t}>a</{t}>" for t in rnd.choices(["p", "h2", "div", "em", "pre"], k=20_000)) + "</article>"
    nodes, paths, _ = wrappers.form(long, frozenset())
    other, more, _ = wrappers.form(long.replace("<p>", "<p><i>z</i>"), frozenset())
    both, paths = wrappers.align(nodes, other), paths | more
    assert wrappers.Reader(wrappers.dump(both, paths)).read(long, frozenset()).count("a") == 20_000
