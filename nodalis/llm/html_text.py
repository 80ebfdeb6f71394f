"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: stretches of text between block-level tags, with the tags, classes
and ids of their ancestors and the share of their text that lies in links. The field scores every
block as article or not from ancestor and text features, and every step from one block to the next;
Viterbi finds the best labelling of the whole page.

It is trained on labelled pages of two kinds. ``SAMPLE_PAGES`` pages of the table, those with the
smallest hashes of their ids, are labelled by their own semantic markup and used three times: as
they are, with the semantic tags hidden, and with them turned into class names. Further
``LAYOUT_PAGES`` pages are laid out from parts whose labels are known (menus, notices, adverts,
forms, side bars, comments, articles), filled with prose of the sample. Half of all training pages
come without the summary of their telling ancestors, so that the field learns from tags, names and
text as well.

A page is read in one pass whose work grows with its length: a tag's end is looked for once, elements
are nodes that point to their parents, and a node's score is its parent's and its own.

Defined cases: null and empty pages have the empty text; pages of any length and depth are read whole;
a tag that breaks off with the page is dropped, quotes that never close do not count as quotes, unknown
end tags are ignored; scripts, styles and the like hold no text and end at their end tag
or with the page, as in browsers; svg, which a tag of a page's text ends, is read as an element whose
text is not the page's; character references are decoded as in HTML, broken ones stay;
repeated rows get the same text each; further columns are kept; a table without any text trains on the layouts alone, with
stand-in words; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import table

SAMPLE_PAGES = 200
LAYOUT_PAGES = 700
SEED = 42
OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)|<!--|<[!?/]")
QUOTED_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
RAW = frozenset("script style template textarea select title iframe".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark noscript object q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
CLOSES |= {t: frozenset(["p"]) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
LEAVES_SVG = frozenset("b big body br center code dd dt em embed head i img li listing menu meta nobr ruby s small span strike strong sub sup tr td th tt u var".split()) | {t for t, ended in CLOSES.items() if "p" in ended}
HOLDERS = frozenset("ul ol dl table tbody thead body html div article section main aside nav object foreignobject".split())
ARTICLE = frozenset(["article", "main"])
AROUND = frozenset("nav aside footer header form button menu dialog svg".split())
NOT_TEXT = frozenset("ad ads advert advertisement banner sponsor sponsored promo comment comments responses replies cookie notice consent menu nav navbar navigation sidebar widget footer header masthead breadcrumb breadcrumbs share social related newsletter signup subscribe popup modal pagination pager legal copyright toolbar".split())
TEXT = frozenset("article post content entry story main body text".split())
NOT_STEM = re.compile("comment|respond|disqus|repl(?:y|ies)|sidebar|colophon|advert|adsby|adsense|adslot|adunit|adbox|sponsor|promo|banner|cookie|consent|gdpr|newsletter|signup|subscri|breadcrumb|pagin|navbar|navigation|menu|masthead|footer|copyright|related|recommend|trending|popular|sharing|social|widget|popup|modal|toolbar|legal|disclaim|notice")
PAGE = frozenset(["html", "body"])


@lru_cache(1 << 14)
def keys(tag: str, names: tuple[str, ...]) -> tuple[str, ...]:
    """The features of an element on its own; names of the page's outer elements speak of the whole page."""
    if tag in PAGE:
        return (f"in:{tag}",)
    stems = {m for n in names for m in NOT_STEM.findall(n)}
    return (f"in:{tag}", *(f"name:{n}" for n in names), *(f"stem:{m}" for m in sorted(stems)))


@lru_cache(1 << 14)
def told(names: tuple[str, ...]) -> tuple[bool, bool]:
    """Whether names tell of another part than the article, and whether of the article."""
    return any(n in NOT_TEXT or NOT_STEM.search(n) for n in names), bool(TEXT.intersection(names))


class Node:
    """An open element: its parent, tag and names, and what its ancestors and it tell of a block inside.

    ``fresh`` are the features that no ancestor has; a path's features are those of all its nodes.
    """

    __slots__ = ("parent", "tag", "names", "fresh", "outer", "said", "denied", "inside", "fenced", "score")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...], fresh: list[str]):
        self.parent, self.tag, self.names, self.fresh, self.score = parent, tag, names, fresh, None
        said, self.denied, self.inside, self.fenced = (parent.said, parent.denied, parent.inside, parent.fenced) if parent else ("", False, False, False)
        self.outer = tag if tag not in INLINE else parent.outer if parent else ""
        against, for_ = told(names) if names and tag not in PAGE else (False, False)
        if tag in AROUND and not (tag == "header" and said == "yes") or against and not for_:
            said, self.denied = "no", True
        elif tag in ARTICLE or for_ and not against:
            said = "yes"
        self.said = said
        self.fenced = self.fenced or tag in AROUND and not (tag == "header" and self.inside) or against and not for_
        self.inside = self.inside or tag in ARTICLE


@dataclass
class Block:
    """A leaf block: its text, the innermost element around it, and the characters within links."""

    parts: list[str] = field(default_factory=list)
    node: Node | None = None
    linked: int = 0
    text: str = ""


class Stack:
    """The open elements, with the places of every tag's, so that no search walks over the others."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.holders: list[int] = []
        self.held: dict[str, int] = {}

    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def count(self, tag: str) -> int:
        return len(self.places.get(tag, ()))

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        own = keys(tag, names)
        fresh = [k for k in own if not self.held.get(k)]
        for k in own:
            self.held[k] = self.held.get(k, 0) + 1
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in HOLDERS:
            self.holders.append(len(self.nodes))
        self.nodes.append(Node(self.top(), tag, names, fresh))

    def pop_to(self, place: int) -> None:
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in HOLDERS:
                self.holders.pop()
            for k in keys(node.tag, node.names):
                self.held[k] -= 1


def tag_end(html: str, begun: re.Match, quotes: bool) -> tuple[int, str | None, bool]:
    """Where a tag or comment ends, its attributes (None if the page ends before it does), and whether a
    quote may still hide a tag's end: once one never closes, none is looked for again."""
    if begun[0] == "<!--":
        end = html.find("-->", begun.end())
        return (end + 3 if end >= 0 else len(html)), None, quotes
    whole = QUOTED_END.match(html, begun.end()) if quotes and begun[2] else None
    end = whole.end() if whole else html.find(">", begun.end()) + 1
    return end or len(html), html[begun.end() : end - 1] if end else None, quotes and bool(whole or not begun[2])


def raw_end(html: str, name: str, at: int) -> int:
    """Where a script or the like that begins before ``at`` has ended."""
    end = RAW_END[name].search(html, at)
    return (html.find(">", end.end()) + 1 if end else 0) or len(html)


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page that hold any text, in page order."""
    found: list[Block] = []
    stack = Stack()
    current = Block()
    drawn = False  # whether the current block is text of an svg element

    def close() -> None:
        nonlocal current
        if current.parts:
            current.text = " ".join(unescape("".join(current.parts)).split())
            if current.text:
                found.append(current)
        current = Block()

    def say(text: str) -> None:
        nonlocal drawn
        pictures = stack.count("svg")
        if text and not (pictures and text.isspace()):
            if bool(pictures) != drawn:
                close()
                drawn = bool(pictures)
            if not current.parts:
                current.node = stack.top()
            current.parts.append(text)
            if stack.count("a"):
                current.linked += len(text)

    at, quotes = 0, True
    while begun := OPEN.search(html, at):
        say(html[at : begun.start()])
        name, ending = (begun[2] or "").lower(), bool(begun[1])
        at, attributes, quotes = tag_end(html, begun, quotes)
        if name in RAW and not ending and not (stack.count("svg") and (attributes or "").endswith("/")):
            at = raw_end(html, name, at)
        if not name or name in RAW or attributes is None:
            continue
        pictures = stack.count("svg")
        if ending:
            place = stack.last(name)
            if name not in INLINE and (not pictures or drawn):
                close()
            if place >= 0:
                stack.pop_to(place)
                if pictures and not stack.count("svg") and name not in INLINE and name != "svg":
                    close()
            continue
        if pictures and name in LEAVES_SVG:
            held = max(stack.last("foreignobject"), stack.last("desc"))
            svgs = stack.places["svg"]
            first = bisect_right(svgs, held)
            if first < len(svgs):
                stack.pop_to(svgs[first])
        if name not in INLINE and name != "svg" and (not pictures or drawn):
            close()
        if name not in INLINE:
            place = max((stack.last(t) for t in CLOSES.get(name, ())), default=-1)
            if place >= 0 and place > (stack.holders[-1] if stack.holders else -1):
                stack.pop_to(place)
        if name not in VOID and not attributes.endswith("/"):
            named = tuple(sorted({n for m in NAMES.finditer(attributes) for n in NAME.findall((m[1] or m[2] or m[3] or "").lower())})) if attributes else ()
            stack.push(name, named)
    say(html[at:])
    close()
    return found


def chain(node: Node | None) -> list[Node]:
    """The elements around a block, outermost first."""
    out = []
    while node:
        out.append(node)
        node = node.parent
    return out[::-1]


def last_features(node: Node | None, signal: bool) -> list[str]:
    told = [f"signal:{node.said}:{node.denied}" if node else "signal::False"] if signal else []
    return [f"parent:{node.outer if node else ''}", *told, "any"]


def path_features(node: Node | None, signal: bool = True) -> list[str]:
    return [f for n in chain(node) for f in n.fresh] + last_features(node, signal)


def kind_of(block: Block) -> str:
    """What a block's text looks like: links, a few words, sentences or other words."""
    if 2 * block.linked > len(block.text):
        return "links"
    return "short" if block.text.count(" ") < 4 else "prose" if block.text[-1] in ".!?…:”\"'" else "words"


def text_features(block: Block, place: int, count: int) -> list[str]:
    text, words = block.text, block.text.count(" ") + 1
    prose = kind_of(block)
    return [
        f"holds:{block.node.outer if block.node else ''}:{prose}",
        f"denied:{bool(block.node and block.node.denied)}:{prose}",
        f"words:{min(words.bit_length(), 8)}",
        f"links:{min(3, 4 * block.linked // max(1, len(text)))}",
        f"ends:{text[-1] in '.!?…:' and words > 3}",
        f"marks:{'©' in text or '|' in text or '·' in text}",
        f"commas:{min(2, text.count(','))}",
        f"place:{4 * place // count}",
        f"edge:{'first' if place == 0 else 'last' if place == count - 1 else ''}",
    ]


def features(page: list[Block], signal: bool = True) -> list[list[str]]:
    return [path_features(b.node, signal) + text_features(b, i, len(page)) for i, b in enumerate(page)]


def marked(node: Node | None) -> bool:
    """The label that a page's own semantic markup gives a block."""
    return bool(node and node.inside and not node.fenced)


SEMANTIC = {"article": "post content entry", "main": "main content", "nav": "nav menu", "aside": "sidebar widget", "footer": "footer", "header": "header masthead", "form": "form"}


def hidden(node: Node | None, names: bool, tags: bool = False, paragraph: str = "p") -> Node | None:
    """A path without semantic tags and names, or with the tags as names, or (``tags``) as it is; and with
    another tag for paragraphs."""
    stack = Stack()
    for n in chain(node):
        tag = paragraph if n.tag == "p" else n.tag
        if tags:
            stack.push(tag, n.names)
        else:
            stack.push("div" if n.tag in SEMANTIC else tag, tuple(SEMANTIC.get(n.tag, "").split()) + n.names if names else ())
    return stack.top()


def layout(draw: random.Random, prose: list[str]) -> list[tuple[str, bool]]:
    """A page of parts as (html, is article); tags and names vary, so that no single one decides."""

    def words(low: int, high: int) -> str:
        source = draw.choice(prose).split() or ["text"]
        n = draw.randint(low, high)
        at = draw.randrange(len(source))
        return " ".join((source * (1 + (at + n) // len(source)))[at : at + n])

    def sentences() -> str:
        return " ".join(words(5, 16).capitalize() + "." for _ in range(draw.randint(1, 6)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(n))

    def holder(tag: str, names: str, inner: list[str], label: bool) -> list[tuple[str, bool]]:
        plain = draw.random() if tag != "div" or label else draw.uniform(0.35, 0.93)  # a bare div tells of no other part
        kind = draw.choice(["class", "id"])
        head = f"<{tag}>" if plain < 0.35 else f'<div {kind}="{draw.choice(names.split())}">' if plain < 0.8 else f'<{tag} {kind}="{names}">' if plain < 0.93 else "<div>"
        ends = "</div>" if head.startswith("<div") else f"</{tag}>"
        return [(head + inner[0], label), *((x, label) for x in inner[1:]), (ends, label)]

    def said_in(style: str, text: str) -> str:
        """A paragraph of a page whose paragraphs are elements of one kind, or are parted by breaks."""
        plain = {"br": f"{text}<br>", "brbr": f"{text}<br/><br/>", "span": f"<div><span>{text}</span></div>", "named": f'<div class="{draw.choice(["text", "para", "block", "c1", "row"])}">{text}</div>', "nested": f"<div><div>{text}</div></div>"}
        return plain.get(style) or f"<{style}>{text}</{style}>"

    def bit(text: str) -> str:
        """A line of another part, in any of the elements that articles use too."""
        return said_in(draw.choice(["p", "p", "p", "div", "div", "br", "span", "nested", "section"]), text)

    style = draw.choice(["p"] * 6 + ["div"] * 3 + ["br", "brbr", "span", "named", "nested", "section"])
    mixed = draw.random() < 0.25
    body = [f"<h{draw.choice('112')}>{words(3, 9)}</h1>"] if draw.random() < 0.8 else []
    for _ in range(draw.randint(1, 12)):
        of = draw.choice(["p", "div", "br", "named"]) if mixed else style
        items = [sentences() if draw.random() < 0.5 else words(3, 9) for _ in range(draw.randint(2, 5))]
        listed = draw.choice(["ul", "ol"])
        body.append(draw.choice([said_in(of, sentences())] * 8 + [
            f"<h2>{words(2, 6)}</h2>", f"<blockquote>{said_in(of, sentences())}</blockquote>", f"<{listed}>{''.join(f'<li>{x}</li>' for x in items)}</{listed}>",
            f"<dl>{''.join(f'<dt>{words(1, 4)}</dt><dd>{x}</dd>' for x in items)}</dl>", f"<table>{''.join(f'<tr><td>{words(1, 4)}</td><td>{x}</td></tr>' for x in items)}</table>",
            said_in(of, words(1, 5)), f"<pre>{words(3, 9)}</pre>", said_in(of, f"{words(4, 9)} <a href='#'>{words(1, 3)}</a> {sentences()}")]))
    comment = [f'<div class="{draw.choice(["comment", "comment-body", "reply", "d-flex", "item"])}">{bit(words(1, 2))}{bit(sentences())}</div>' for _ in range(draw.randint(1, 5))]
    said = [f"<li><cite>{words(1, 2)}</cite>{bit(sentences())}</li>" for _ in range(draw.randint(1, 5))]
    before = [
        holder("header", "header masthead top", [f"<div>{words(1, 3)}</div>{bit(words(2, 6))}"], False),
        holder("nav", "nav menu navbar", [f"<ul>{links(draw.randint(3, 9))}</ul>"], False),
        holder("div", "breadcrumb crumbs", [f"<a href='#'>{words(1, 2)}</a> | <a href='#'>{words(1, 2)}</a>"], False),
        holder("div", "cookie notice consent", [f"{bit(sentences())}<button>{words(1, 2)}</button>"], False),
        holder("div", "ad advert banner sponsored", [f"{sentences()}"], False),
    ]
    after = [
        holder("aside", "sidebar widget related", [f"<h3>{words(1, 3)}</h3><ul>{links(draw.randint(2, 7))}</ul>"], False),
        holder("form", "newsletter form signup search", [f"{bit(words(3, 9))}<label>{words(1, 2)}</label><input><button>{words(1, 2)}</button>"], False),
        holder("ol", "commentlist comments thread discussion", said, False),
        holder("div", "respond reply comment-respond", [f"<h3>{words(1, 3)}</h3>{bit(words(3, 9))}"], False),
        holder("div", "adsbygoogle ad-slot adbox advertisement sponsored-content", [sentences()], False),
        holder("footer", "colophon site-footer foot footer-bottom", [f"<p>&copy; 20{draw.randint(10, 25)} {words(1, 4)}</p>{bit(words(2, 8))}"], False),
        [(f"<center>&copy; 20{draw.randint(10, 25)} {words(1, 4)} | {words(1, 3)}</center>", False)],
        [(f"<center><font size='1'><a href='#'>{words(1, 2)}</a> | <a href='#'>{words(1, 2)}</a> | {words(1, 3)}</font></center>", False)],
        holder("section", "comments comment-area discussion responses", comment, False),
        holder("section", "comments comment responses replies", [f"{bit(sentences())}"] if draw.random() < 0.3 else [f"<h3>{words(1, 3)}</h3>"] + [f'<div class="comment">{bit(words(1, 2))}{bit(sentences())}</div>' for _ in range(draw.randint(1, 5))], False),
        holder("div", "ad advert promo", [f"{bit(sentences())}"], False),
        holder("div", "share social", [f"<a href='#'>{words(1, 1)}</a> <a href='#'>{words(1, 1)}</a>"], False),
        holder("footer", "footer bottom copyright", [f"<p>&copy; {words(1, 4)} &middot; {words(2, 8)}.</p>"], False),
    ]
    alone = draw.random() < 0.25  # a page of its article only
    page = [x for part in before if draw.random() < 0.6 for x in part] if not alone and draw.random() < 0.8 else []
    middle = holder(draw.choice(["article", "article", "main", "div", "section"]), "article post content entry main story", body, True) if draw.random() < 0.75 else [(x, True) for x in body]
    for _ in range(draw.choice([0, 0, 1, 2])):
        at = draw.randint(1, len(middle) - 1) if len(middle) > 1 else 0
        middle[at:at] = draw.choice([
            holder("div", "ad advert sponsored notice promo", [bit(sentences()) if draw.random() < 0.5 else sentences()], False),
            holder("aside", "note pullout sidebar", [bit(sentences())], False),
            holder("div", "adsbygoogle ad-unit advert", [sentences()], False),
            holder("aside", "related sidebar", [f"<h3>{words(1, 3)}</h3><ul>{links(draw.randint(1, 4))}</ul>"], False),
            holder("form", "newsletter signup subscribe", [f"{bit(words(3, 9))}<button>{words(1, 2)}</button>"], False),
        ])
    behind = [x for part in draw.sample(after, len(after)) if draw.random() < 0.35 for x in part] if not alone and draw.random() < 0.7 else []
    if draw.random() < 0.2:  # columns of a table
        page, middle, behind = [("<table><tr><td>", False), *page, ("</td>", False), ("<td>", True)], [*middle, ("</td>", True)], [("<td>", False), *behind, ("</td></tr></table>", False)]
    elif draw.random() < 0.25:  # parts inside the element that holds the article
        page, middle = [], [*([("<main>", True)] if draw.random() < 0.5 else [('<div id="content">', True)]), *page, *middle]
        behind = [*behind, ("</main></div>", False)]
    return page + middle + behind


def labelled(pages: list[str], layouts: int = LAYOUT_PAGES, seed: int = SEED) -> list[tuple[list[list[str]], list[int]]]:
    """(features, labels) of the training pages."""
    out, prose, draw = [], [], random.Random(seed)
    for html in pages:
        page = blocks(html)
        labels = [int(marked(b.node)) for b in page]
        prose += [b.text for b, label in zip(page, labels, strict=True) if label]
        if not page or not any(labels):
            continue
        out.append((features(page, draw.random() < 0.5), labels))
        for view in ({"names": False}, {"names": False, "paragraph": "div"}, {"names": True}, {"names": True, "tags": True, "paragraph": "div"}, {"names": True, "paragraph": "div"}):
            # without names nothing would tell an advert's or footer's sentence from the article's
            told_apart = [(b, y) for b, y in zip(page, labels, strict=True) if view["names"] or y or not (b.node and b.node.denied) or kind_of(b) in ("links", "short")]
            unmarked = [Block(b.parts, hidden(b.node, **view), b.linked, b.text) for b, _ in told_apart]
            out.append((features(unmarked, draw.random() < 0.5), [y for _, y in told_apart]))
    for _ in range(layouts):
        parts = layout(draw, prose or ["some words that stand for the prose of a page, one after another"])
        html = "".join(f"{x}\x00{int(label)}\x01" for x, label in parts)
        page, labels = [], []
        for block in blocks(html):  # every part ends with its label; the block that holds the mark has it
            marks = re.findall("\x00([01])\x01", block.text)
            block.text = " ".join(re.sub("\x00[01]\x01", " ", block.text).split())
            if block.text:
                page.append(block)
                labels.append(int(marks[0]) if marks else None)
            elif marks and labels and labels[-1] is None:
                labels[-1] = int(marks[0])
        following = 0
        for i in range(len(labels) - 1, -1, -1):
            following = labels[i] = following if labels[i] is None else labels[i]
        out.append((features(page, draw.random() < 0.5), labels))
    return [(f, y) for f, y in out if f]


@dataclass(frozen=True)
class Field:
    """A trained field: weights of features for the label article, and of steps (from, to)."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.15, ridge: float = 0.0001) -> Field:
        """Maximum penalised likelihood by Adam on the whole training set, forward-backward in log space."""
        names = sorted({f for page, _ in pages for block in page for f in block})
        index = {f: i for i, f in enumerate(names)}
        lengths = np.array([len(y) for _, y in pages])
        rows, longest = len(pages), int(lengths.max())
        cells = [(r * longest + t, index[f]) for r, (page, _) in enumerate(pages) for t, block in enumerate(page) for f in block]
        cell, feature = (np.array(x) for x in zip(*cells, strict=True))
        inside = np.arange(longest) < lengths[:, None]
        truth = np.zeros((rows, longest), np.int64)
        for r, (_, y) in enumerate(pages):
            truth[r, : len(y)] = y
        both = inside[:, 1:]
        seen = np.array([[((truth[:, :-1] == a) & (truth[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
        w, steps = np.zeros(len(names)), np.zeros((2, 2))
        moments = [np.zeros(len(names)), np.zeros(len(names)), np.zeros((2, 2)), np.zeros((2, 2))]
        total = inside.sum()
        for turn in range(1, rounds + 1):
            own = np.zeros((rows, longest, 2))
            own[..., 1] = np.bincount(cell, w[feature], rows * longest).reshape(rows, longest)
            forward, backward = own.copy(), np.zeros((rows, longest, 2))
            for t in range(1, longest):
                forward[:, t] += np.logaddexp(forward[:, t - 1, :1] + steps[0], forward[:, t - 1, 1:] + steps[1])
            for t in range(longest - 2, -1, -1):
                ahead = own[:, t + 1] + backward[:, t + 1]
                back = np.logaddexp(ahead[:, :1] + steps[:, 0], ahead[:, 1:] + steps[:, 1])
                backward[:, t] = np.where(inside[:, t + 1, None], back, 0.0)
            belief = forward + backward
            norm = np.logaddexp(belief[..., 0], belief[..., 1])
            chance = np.exp(belief[..., 1] - norm)
            gap = np.where(inside, truth - chance, 0.0)
            grad_w = np.bincount(feature, gap.ravel()[cell], len(names)) / total - ridge * w
            pair = forward[:, :-1, :, None] + steps + (own + backward)[:, 1:, None, :] - norm[:, :-1, None, None]
            expected = np.where(both[..., None, None], np.exp(np.minimum(pair, 0.0)), 0.0).sum(axis=(0, 1))
            grad_s = (seen - expected) / total - ridge * steps
            for k, (value, grad) in enumerate(((w, grad_w), (steps, grad_s))):
                first, second = moments[2 * k], moments[2 * k + 1]
                first += 0.1 * (grad - first)
                second += 0.01 * (grad**2 - second)
                value += rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
        return cls(dict(zip(names, w.tolist(), strict=True)), tuple(map(tuple, steps.tolist())))

    def decode(self, own: list[float]) -> list[int]:
        """Viterbi: the best labels for the blocks' scores."""
        (aa, ab), (ba, bb) = self.steps
        no, yes, came = 0.0, own[0], []
        for score in own[1:]:
            to_no, to_yes = (no + aa < yes + ba), (no + ab < yes + bb)
            came.append((to_no, to_yes))
            no, yes = (yes + ba if to_no else no + aa), (yes + bb if to_yes else no + ab) + score
        label = int(yes > no)
        out = [label]
        for step in reversed(came):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def extract(self, html: str) -> str:
        """The page's article blocks, joined by one space."""
        page = blocks(html)
        if not page:
            return ""
        weigh, own = self.weights.get, []
        for i, block in enumerate(page):
            open_, node = [], block.node
            while node and node.score is None:
                open_.append(node)
                node = node.parent
            score = node.score if node else 0.0
            for n in reversed(open_):
                score = n.score = score + sum(weigh(f, 0.0) for f in n.fresh)
            own.append(score + sum(weigh(f, 0.0) for f in last_features(block.node, True) + text_features(block, i, len(page))))
        return " ".join(b.text for b, label in zip(page, self.decode(own), strict=True) if label)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Field:
    """Fit on a bounded sample: the ``sample`` pages with the smallest hashes of their ids."""
    rows = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(id_col).alias("at"), F.col(html_col).alias("html"))
    chosen = [r["at"] for r in rows.select("at").distinct().orderBy("at").limit(sample).collect()]
    if not chosen:
        return Field.fit(labelled([]))
    # hashes are chosen first, so that no task sends pages that are not in the sample
    found = rows.where(F.col("at").isin(chosen)).groupBy("at").agg(F.min("html").alias("html"))
    return Field.fit(labelled([r["html"] for r in found.orderBy("at").collect()]))


def extract(pages: DataFrame, model: Field, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with its text as ``main_text`` (a column of that name gives way)."""
    kept = [c for c in pages.columns if c not in (html_col, "main_text")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([model.extract(x.as_py() or "") for x in batch.column(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], [*kept, "main_text"])

    return pages.mapInArrow(read, pages.select(*kept).withColumn("main_text", F.lit("").cast("string")).schema)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
