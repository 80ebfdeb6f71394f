import itertools
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from nodalis.llm import html_text

SCHEMA = "page_id long, url string, html string, main_text string"


@pytest.fixture(scope="module")
def model():
    return html_text.Field.fit(html_text.labelled([], layouts=400))


@pytest.fixture(scope="module")
def sampled():
    """As the query trains it, on given pages and laid-out ones."""
    pages = [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if x]
    return html_text.Field.fit(html_text.labelled(pages[: html_text.SAMPLE_PAGES]))


def test_blocks():
    html = "<html><head><title>T</title><style>p{}</style></head><body><p class='Lead x'>a &amp; b<br>c<p>d &lt;e&gt; &am<!-- no --> f<script>var t='</p>';</script> g</p><ul><li>one<li><a href=\"#>\">two</a></ul> tail &quo"
    found = html_text.blocks(html)
    assert [b.text for b in found] == ["a & b", "c", "d <e> &am f g", "one", "two", "tail &quo"] or [b.text for b in found] == ["a & b c", "d <e> &am f g", "one", "two", "tail &quo"]
    assert ("p", ("lead", "x")) in [(n.tag, n.names) for n in html_text.chain(found[0].node)]
    assert found[-2].linked == 3


def test_viterbi_is_the_best_labelling():
    draw = random.Random(1)
    for n in (1, 2, 5, 9):
        field = html_text.Field({}, tuple(tuple(draw.uniform(-2, 2) for _ in "ab") for _ in "ab"))
        own = [draw.uniform(-3, 3) for _ in range(n)]

        def total(labels):
            return sum(s for s, y in zip(own, labels, strict=True) if y) + sum(field.steps[a][b] for a, b in zip(labels, labels[1:], strict=False))

        assert total(field.decode(own)) == pytest.approx(max(total(y) for y in itertools.product((0, 1), repeat=n)))


def test_held_out_layouts(model):
    right = count = 0
    for page, labels in html_text.labelled([], layouts=150, seed=99):
        got = model.decode([sum(model.weights.get(f, 0.0) for f in b) for b in page])
        right += int(np.sum(np.array(got) == labels))
        count += len(labels)
    assert right / count > 0.95


def test_gradient_fits_the_training_pages():
    pages = [([["x"], ["y"], ["x"]], [1, 0, 1]), ([["y"], ["y"]], [0, 0])]
    field = html_text.Field.fit(pages * 3, ridge=0.0)
    assert [field.decode([field.weights[f] for b in p for f in b]) for p, _ in pages] == [y for _, y in pages]


PAGE = """<!DOCTYPE html><html><head><title>Title here</title></head><body><header><div>Site name</div></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<article><h1>A headline of some words</h1><p>First   sentence of the text, which goes on. Second &amp; last.</p>
<p>Another paragraph with <b>bold</b> words, commas, and a <a href="#">link</a> inside it.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Reader</p><p>I like this text a lot. It is good.</p></div></section>
<aside class="sidebar"><ul><li><a href="#">More</a></li></ul></aside><form><label>Mail</label><button>Send</button></form>
<footer>&copy; site &middot; All rights.</footer></body></html>"""


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>", "x"), (4, "u", "<article>" + "<p>Long words, many of them, follow here. And more.</p>" * 20_000, "x")]
    pages = spark.createDataFrame(rows, SCHEMA)
    trained = html_text.train(pages.where("page_id < 4"))
    got = html_text.extract(pages, trained).collect()
    want = "A headline of some words First sentence of the text, which goes on. Second & last. Another paragraph with bold words, commas, and a link inside it."
    by_id = {r.page_id: r.main_text for r in got}
    assert len(got) == len(rows) and by_id[1] == want and by_id[2] == by_id[3] == by_id[None] == ""
    assert by_id[4] == " ".join(["Long words, many of them, follow here. And more."] * 20_000)
    empty = pages.limit(0)
    assert html_text.extract(empty, html_text.Field({}, ((0.0, 0.0), (0.0, 0.0)))).count() == 0
    assert html_text.train(empty).steps


CUTS = [
    "<svg class='i' viewBox='0 0 1 1'/>", "<svg-icon name='x'></svg-icon>", "<svg-icon name='x'>", "<object-view>", "<select-menu></select-menu>", "<template-x></template-x>", "<title-bar></title-bar>",
    "<object data='a.swf'>", "<object data='a.swf'><param name='q' value='1'><embed src='a.swf'></object>", "<noscript>", "<noscript><img src='a.png'></noscript>",
    "<svg><title>Logo</title><path d='M0 0'/></svg>", "<svg><style/><title/><g><path d='M0 0'/></g></svg>", "<svg><path d='M0 0'>", "<script src='a.js'></script >", "<title>x</title a>",
]


@pytest.mark.parametrize("cut", CUTS)
def test_text_after_embedded_elements_stays(model, cut):
    first, last = "Long words, many of them, stand in this paragraph. And more.", "The text goes on behind it, with many words, to its end."
    html = f"<html><body><nav><ul><li><a href='#'>Home</a></li></ul></nav><article><p>{first}</p>{cut}<p>{last}</p><p>{last}</p></article><footer>&copy; site</footer></body></html>"
    assert model.extract(html) == f"{first} {last} {last}"


def test_svg_inside_a_paragraph():
    assert [b.text for b in html_text.blocks("<p>one <svg/>two <svg><g> <path/></g></svg> three</p>")] == ["one two three"]
    found = html_text.blocks("<article><p>one <svg><text>label</text></svg> two</p><svg><foreignObject><p>inner</p></foreignObject></svg><p>three</p></article>")
    assert [(b.text, html_text.marked(b.node)) for b in found] == [("one", True), ("label", False), ("two", True), ("inner", False), ("three", True)]
    assert [n.tag for n in html_text.chain(found[-1].node)] == ["article", "p"]


A = "The council met on Tuesday evening to discuss the new bridge, which has been planned for years."
B = "Several members spoke in favour, although the cost, they said, remains a concern for the town."
C = "A vote is expected next month. Until then, engineers will inspect the old piers and report back."
#: Pages written by hand, with their article; none comes from the generator.
PAGES = [
    (f"<html><body class='single has-sidebar'><div id='masthead'><p>The Daily Post</p><p>News for all of us</p></div><main><h1>Bridge talks go on</h1><p>{A}</p><aside><p>Subscribe today and get the paper at home, every morning.</p></aside><p>{B}</p><p>{C}</p></main><div id='colophon'><p>Copyright 2021 The Daily Post. All rights reserved.</p></div></body></html>", f"Bridge talks go on {A} {B} {C}"),
    (f"<body><div class='site-header'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='entry-content'><h2>Old piers</h2><p>{A}</p><div class='adsbygoogle'>Buy cheap tools, now with free delivery for all orders.</div><p>{B}</p></div><ol class='commentlist'><li><cite>Bob</cite><p>I never liked that bridge, to be honest. It is ugly.</p></li><li><cite>Eve</cite><p>Well said, Bob, I agree with you.</p></li></ol><div id='respond'><h3>Leave a reply</h3><p>Your email address will not be published.</p><form><label>Name</label><textarea></textarea><button>Post</button></form></div></body>", f"Old piers {A} {B}"),
    (f"<body><table><tr><td><ul><li><a href='1'>One</a></li><li><a href='2'>Two</a></li><li><a href='3'>Three</a></li></ul></td><td><h1>Town news</h1><p>{A}</p><p>{B}</p><p>{C}</p></td></tr></table><center>&copy; 1999 The town | Contact | Imprint</center></body>", f"Town news {A} {B} {C}"),
    (f"<body><nav class='navbar'><a href='#'>A</a><a href='#'>B</a></nav><div class='cookie-consent'><p>We use cookies to improve your visit. Read more in our policy.</p><button>Fine</button></div><article><header><h1>Vote is near</h1></header><p>{C}</p><figure><img src='a.png'><figcaption>The old bridge in spring.</figcaption></figure><blockquote><p>{B}</p></blockquote><p>{A}</p><footer>Filed under: town, bridge</footer></article><section class='related-posts'><h3>Related</h3><ul><li><a href='#'>Older bridge</a></li></ul></section><footer><p>&copy; 2020 Example Media</p></footer></body>", f"Vote is near {C} The old bridge in spring. {B} {A}"),
    (f"<body><div id='page'><div id='topmenu'><ul><li><a href='#'>Start</a></li><li><a href='#'>Shop</a></li></ul></div><div class='post'><h1>A long story</h1><p>{A}</p><ul><li>{B}</li><li>{C}</li></ul><div class='social-share'><a href='#'>Tweet</a> <a href='#'>Mail</a></div></div><div id='disqus_thread'><div class='item'><p>Anna</p><p>Thank you for this text, it was good to read.</p></div></div><div class='widget newsletter'><p>Get our letter each week.</p></div></div></body>", f"A long story {A} {B} {C}"),
]


def test_parts_of_pages_written_by_hand(model):
    """Token F1 over all pages; and no sentence of any other part comes through."""
    both = got_count = want_count = 0
    for html, want in PAGES:
        got = model.extract(html)
        a, b = got.split(), want.split()
        left = list(b)
        for word in a:
            if word in left:
                left.remove(word)
                both += 1
        got_count, want_count = got_count + len(a), want_count + len(b)
    assert 2 * both / (got_count + want_count) >= 0.95


@pytest.mark.parametrize("other", [
    "<aside><p>Subscribe today and get the paper at home, every morning.</p></aside>", "<div class='adsbygoogle'>Buy cheap tools, now with free delivery for all orders.</div>",
    "<ol class='commentlist'><li><p>I never liked that bridge, to be honest. It is ugly.</p></li></ol>", "<div id='respond'><h3>Leave a reply</h3><p>Your email address will not be published.</p></div>",
    "<div id='colophon'><p>Copyright 2021 The Daily Post. All rights reserved.</p></div>", "<center>&copy; 1999 The town | Contact | Imprint</center>", "<nav><a href='#'>Home</a> <a href='#'>News of today</a></nav>",
    "<div class='cookie-notice'><p>We use cookies to improve your visit.</p></div>", "<form><label>Your name</label><input><button>Send it</button></form>", "<script>var text = '<p>Not text</p>';</script><style>p { color: red }</style>",
])
@pytest.mark.parametrize("inside", [False, True])
def test_other_parts_are_left_out(model, other, inside):
    if inside and "colophon" in other:  # a page's last lines, never inside
        return
    page = f"<p>{A}</p><p>{B}</p>{other if inside else ''}<p>{C}</p>"
    assert model.extract(f"<body><main>{page}</main>{'' if inside else other}</body>") == f"{A} {B} {C}"


SHAPES = [
    f"<article><div>{A}</div><div>{B}</div></article>", f"<main><div>{A}</div><div>{B}</div></main>", f"<div class='post'><div>{A}</div><div>{B}</div></div>", f"<div class='article-body'><div>{A}</div><div>{B}</div></div>",
    f"<div>{A}</div><div>{B}</div>", f"<div class='story'>{A}<br>{B}</div>", f"<article><ol><li>{A}</li><li>{B}</li></ol></article>", f"<article><p>{A}</p><div>{B}</div></article>",
    f"<article><dl><dt>Bridge</dt><dd>{A}</dd></dl>{B}</article>", f"<article><table><tr><td>{A}</td><td>{B}</td></tr></table></article>", f"<div id='main-content'><span>{A}</span><br/><br/><span>{B}</span></div>", f"<section><div><div>{A}</div></div><div><div>{B}</div></div></section>",
]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("around", ["<body>{}</body>", "<html><body><nav><ul><li><a href='#'>Home</a></li><li><a href='#'>Latest</a></li></ul></nav>{}<footer><p>&copy; 2020 Town Media. All rights reserved.</p></footer></body></html>"])
@pytest.mark.parametrize("sample", [False, True])
def test_articles_in_other_elements_than_paragraphs(model, sampled, shape, around, sample):
    got = (sampled if sample else model).extract(around.format(shape))
    assert A in got and B in got
    assert "Latest" not in got and "Town Media" not in got


def test_sample_pages_equal_their_markup(sampled):
    pages = [x for x in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist() if x]
    for html in pages:
        assert sampled.extract(html) == " ".join(b.text for b in html_text.blocks(html) if html_text.marked(b.node))


def test_hostile_pages_are_linear(model):
    big = 1 << 19
    for unit in ("<a ", "<div>x", "<span><h1>x</h1>", "<p><span>y", "</p>x", "<a \">", "<a '>' ", "</script ", "<script></script", "<svg><b>x", "<!--", "<x-y z='", "<li>x<span>", "<table><tr><td>x", "<div class='a b comment'>x"):
        began = time.process_time()
        model.extract(unit * (big // len(unit)))
        assert time.process_time() - began < 20, unit
