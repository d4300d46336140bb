import os
import random
import re
from html import unescape

import pytest

from lamina.llm import main_text as m

ARTICLE = "<h1>A title here</h1><p>First paragraph, of some words &amp; more.</p><p>Second one\n  with   spaces.</p>"
WANT = "A title here\n\nFirst paragraph, of some words & more.\n\nSecond one with spaces."


def page(before="", after="", inside=ARTICLE, tag="article"):
    return f"<!DOCTYPE html><html><head><title>no</title><style>p{{x:y}}</style><script>var t='</p>';</script></head><body>{before}<{tag}>{inside}</{tag}>{after}</body></html>"


def text(source):
    return m.extract_all([source], m.trained())[0]


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("", ""),
        ("<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav>", "<footer>&copy; someone, all rights kept.</footer>"),
        ("<header><h2>Site name</h2></header><div class='ad'>Buy this now, it is cheap.</div>", "<aside><h3>Related</h3><ul><li><a>One</a></li><li><a>Two</a></li></ul></aside>"),
        ("<div id='cookie-notice'>We use cookies, as you know.<button>OK</button></div>", "<section class='comments'><h3>Comments</h3><p>I don't agree with this at all.</p><p>Nor do I, sorry.</p></section>"),
        ("<form><label>Search</label><input name=q><button>Go</button></form>", "<div class='newsletter'><p>Sign up for our letters.</p></div><footer>end</footer>"),
    ],
)
def test_pages(before, after):
    assert text(page(before, after)) == WANT


def test_empty_and_broken():
    assert [text(s) for s in (None, "", " ", "<html>", "<script>x", "<!-- <p>no</p>")] == [""] * 6
    assert text(page(inside="<h1>A title here<p><b>First paragraph, of some words &amp; more.<br><p>Second one\n with spaces.")) == WANT


def test_parser():
    p = m.parse("<div>a<p>b<p>c <b>d</b><ul><li>e<li>f</ul>g<!-- x > y -->h<br>i</div><script>if (a<b) '</p>'</script>j")
    assert [t for _, t, _ in p.blocks] == ["a", "b", "c d", "e", "f", "gh i", "j"]
    assert [t for _, t, _ in m.parse('<p title="a > b">x &lt;y&gt; &#233; &nbsp;z</p></p></div>w').blocks] == ["x <y> é z", "w"]


def test_no_contradictions():
    rng = random.Random(3)
    for _ in range(40):
        p = m.parse(m.training_page(rng))
        odds = [rng.uniform(-6, 6) for _ in p.tag]
        import numpy as np

        kept = m.decode(p, np.array(odds))
        # The decoder's value is at least that of keeping everything or nothing.
        assert all(t in [b for _, b, _ in p.blocks] for t in kept)


def test_accuracy_on_unseen_layouts():
    rng, right, total = random.Random(77), 0, 0
    for _ in range(150):
        p = m.parse(m.training_page(rng))
        kept = set(m.decode(p, m.trained()(m.features(p))))
        right += sum((m._MARK in t) == (t in kept) for _, t, _ in p.blocks)
        total += len(p.blocks)
    assert right >= 0.985 * total


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query_on_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in m.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_table_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "clash", 1), (2, "u", "", "clash", 1), (2, "u", "", "clash", 1)]
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in m.extract(spark.createDataFrame(rows, schema)).collect()) == [(1, "", 0), (2, "", 0), (2, "", 0)]
    assert m.extract(spark.createDataFrame([], schema)).collect() == []


MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More of it</a></li></ul></nav>"
FOOT = "<footer>&copy; someone, all rights kept.</footer>"


@pytest.mark.parametrize("around", [("", ""), (MENU, FOOT)])
@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('<div id="x">This is one full sentence of the text. This is another one, a little longer.</div>', "This is one full sentence of the text. This is another one, a little longer."),
        ("<article><p>&lt;b&gt; &amp; &quot;x&quot; &#233;&hellip;</p></article>", '<b> & "x" é…'),
        ("<article><p>Rain is due on Monday.</p></article>", "Rain is due on Monday."),
        ("<article><h1>Prices</h1><p>What things cost at present, by weight.</p><table><tr><th>Thing</th><th>Price</th></tr><tr><td>Bread</td><td>Two and a half</td></tr></table><p>That is all we know of it.</p></article>",
         "Prices\n\nWhat things cost at present, by weight.\n\nThing\n\nPrice\n\nBread\n\nTwo and a half\n\nThat is all we know of it."),
        ("<main><h2>Setting up</h2><p>Run this first, then wait.</p><pre>make all\n  make install</pre><p>It takes a minute or two.</p></main>", "Setting up\n\nRun this first, then wait.\n\nmake all make install\n\nIt takes a minute or two."),
        ("<article><h1>The bridge</h1><figure><img src=a.png><figcaption>The old bridge, in winter.</figcaption></figure><p>The bridge was built long ago, of stone.</p></article>",
         "The bridge\n\nThe old bridge, in winter.\n\nThe bridge was built long ago, of stone."),
        ("<div class='post'><h1>Terms</h1><dl><dt>Lease<dd>What you sign, once a year.<dt>Rent<dd>What you pay, every month.</dl></div>", "Terms\n\nLease\n\nWhat you sign, once a year.\n\nRent\n\nWhat you pay, every month."),
        ("<article><blockquote><p>To be, or not to be.</p></blockquote><p>So he said, and went.</p></article>", "To be, or not to be.\n\nSo he said, and went."),
    ],
)
def test_layouts_written_by_hand(around, body, want):
    assert text(f"<html><body>{around[0]}{body}{around[1]}</body></html>") == want


@pytest.mark.parametrize("unit", ["<a ", "<a", "<", "</", "<a '", '<a b="', "<a b='x>", "<!", "<select>", "<object data=x>", "</script ", "<script", "<div>", "</p>", "<ul><li><div>", "<table><div><td><li>", "<p title='", "<svg", "&", "&#", '<a b="x>"', "<li></li>", "<b>x"])
def test_time_is_linear_in_the_page(unit):
    import time

    for source in (unit * 100_000, "<ul>" + "<div>" * 20_000 + unit * 100_000, unit * 100_000 + ">", '<a b="x>"' + unit * 100_000 + "'>\">"):
        start = time.process_time()
        m.parse(source)
        assert time.process_time() - start < 6, source[:20]


def test_a_hundred_thousand_unclosed_tags_take_less_than_a_second():
    import time

    for unit in ("<a ", '<a "', "<a href='x"):
        start = time.process_time()
        m.parse(unit * 100_000)
        assert time.process_time() - start < 1


def test_odd_markup():
    blocks = lambda source: [t for _, t, _ in m.parse(source).blocks]
    assert blocks("1 < 2 and <b>3</b> > 2, a<b") == ["1 < 2 and 3 > 2, a<b"]
    assert blocks('<p class="a>b" id=c>x</p><p>y') == ["x", "y"]
    assert blocks("<p title='it is \"quoted\" > so'>x</p>") == ["x"]
    assert blocks("<select><option>no<select>no</select>no</select>yes<select>never closed") == ["yes never closed"]
    assert blocks("<title>no</title ><p>a</P\n><SCRIPT>if (a < b) '</p>'</SCRIPT>b") == ["a", "b"]
    assert blocks("<ul><li>a<ul><li>b</ul><li>c</ul>d") == ["a", "b", "c", "d"]


def test_decoding_is_the_best_of_all_labellings():
    """Every consistent labelling of small trees, tried one by one."""
    import itertools

    import numpy as np

    rng = random.Random(12)
    for _ in range(60):
        n = rng.randint(1, 7)
        p = m.Page()
        for i in range(1, n):
            p.add("div", rng.randrange(i), "")
        p.blocks = [(rng.randrange(n), f"t{k}", 0) for k in range(rng.randint(0, 6))]
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        best, want = -1e9, None
        for states in itertools.product("MOX", repeat=n):
            if any(states[p.parent[i]] != "X" and states[i] != states[p.parent[i]] for i in range(1, n)):
                continue
            value = sum({"M": odds[i] * (i > 0), "O": -odds[i] * (i > 0), "X": abs(odds[i]) * sum(b == i for b, _, _ in p.blocks) - 0.5 * (i > 0)}[states[i]] for i in range(n))
            if value > best + 1e-9:
                best, want = value, [t for b, t, _ in p.blocks if states[b] == "M" or (states[b] == "X" and odds[b] > 0)]
        assert m.decode(p, odds) == want
