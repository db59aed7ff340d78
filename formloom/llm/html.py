"""Main text of web pages by minimum-cut labelling (operator 8).

A page is cut into blocks: text between the starts and ends of block elements. A linear
classifier, trained on generated pages (:func:`trained`, :data:`WEIGHTS`), gives each block a cost of being
called boilerplate and one of being called content; these are the terminal capacities of a graph.
Neighbours in page order, and blocks that follow each other in one container, are joined by
smoothness edges that weaken with the distance in the tree. The maximum flow from the content
terminal to the boilerplate terminal separates the two; blocks on the content side make the text.

The classifier sees the elements around a block, the words of classes (names that hold an unwelcome word, and names of
unwelcome words alone), links, length, form and tell-tale words of the text, the heading that it stands under, whether its
container is one of several alike, and which share of the page's prose stands beside it. Half of the classes
of the generated pages say nothing and some mislead, so that no list of words decides alone.
An element that marks boilerplate (form, dialog, nav and others, and unwelcome classes) counts by what it holds: one that wraps the page's first heading
and most of its prose, as forms and overlays do on many sites, or most of the article of that heading, says nothing of what is in it.
How far costs and edges may go (:data:`CLIPS`, :data:`SMOOTH`) is chosen on further generated pages by the blocks that
the cut gets wrong.

Character references are decoded; white space inside a block, of any kind and across inline elements
and line breaks, becomes one space; blocks are joined in page order by a newline. Nothing is capped.

Defined results: a null or empty page, or one without content, gives an empty text;
broken markup is read as far as it goes (a start of a block ends an open paragraph, an end without a start is ignored, an
unclosed comment or script runs to the end); repeated rows are kept. All columns of the table
stay, and an output column that exists already is an error.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from formloom.llm.arrow import fresh, per_row
from formloom.llm.tokens import text_of
from formloom.session import load

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_BROKEN = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead caption tr ul".split())
SPACES = frozenset("br td th img wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text to the parser, up to their own end.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements without any article text.
DROPPED = frozenset("template svg math object canvas audio video select button datalist head noscript".split())
#: What may stand in a head; the start of anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript object script style template title".split())
ENDS_P = BLOCKS - {"html", "body", "caption", "tr", "tbody", "tfoot", "thead", "legend", "summary"}

ZONES = frozenset("nav footer aside form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
BAD_WORDS = frozenset("announcement discussion feedback outbrain rail reviews survey taboola teaser thread ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup share sharing social sidebar widget related recommended recommendations trending menu nav navbar navigation breadcrumb breadcrumbs pager pagination footer masthead topbar toolbar comment comments disqus respond reply replies login search form skip copyright legal".split())
GOOD_WORDS = frozenset("article post entry content main story body text".split())

#: Words of class names that neither help nor hurt the word beside them.
NEUTRAL_WORDS = GOOD_WORDS | frozenset("area bar block bottom box col column container fixed global group inner item items left link links list module new outer page panel primary right row secondary section site slot sticky text title top unit user web wrap wrapper".split())
#: Words of texts that are seldom the article's own.
CUES = frozenset("accept advertisement anzeige blog comment comments commentaires comentarios consent contact cookie cookies copyright datenschutz download email facebook follow footer home impressum instagram kommentare linkedin log login loading menu more newsletter next password popular previous privacy publicidad publicité promoted read related replies reply reserved rights save search share sidebar sign signup skip social sponsored subscribe terms topics trending twitter unsubscribe werbung whatsapp youtube".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Containers that may repeat, as comments and teasers do.
ITEMS = frozenset("div li section article dd tr td details figure".split())
#: How far up the tree a block looks.
REACH = 12

#: A zone that holds the page's first heading, or that lies within the article of that heading, counts by its share of the prose there: wholly up to
#: the first share, and not at all from the second on.
WRAPS = (0.3, 0.7)
#: What a character of a text that isn't prose counts for beside one of prose.
LITTLE = 0.25

FEATURES = ("one", "zone", "bad word in a class", "bad class", "page header", "hidden", "article", "good class", "paragraph", "heading", "first heading", "list item", "link share", "length", "sentence end", "short", "cues", "sign", "under cue", "alike", "prose beside", "prose around", "other links", "early", "late", "row", "short in an article", "links in an article", "cues in an article")

_SIGN = re.compile("[©®]|\\ball rights\\b|\\b(?:19|20)\\d\\d\\b.{0,20}$")
_TEXT_WORD = re.compile(r"[^\W\d_]+")


class _Mark:
    """An element that may hold boilerplate by its tag or role (``zone``) or its class (``bad``); these are marked, from within outwards, by ``up``."""

    __slots__ = ("up", "node", "zone", "bad", "depth", "prose", "held", "zoned", "bads")

    def __init__(self, up: _Mark | None, node: _Node, zone: bool, bad: float):
        self.up, self.node, self.zone, self.bad = up, node, zone, bad
        self.depth = up.depth + 1 if up else 0
        self.prose, self.held, self.zoned, self.bads = 0.0, False, 0.0, 0.0


class _Node:
    __slots__ = ("tag", "up", "depth", "mark", "header", "hidden", "article", "inner", "good", "last", "kind", "kinds", "cue", "held", "prose", "around", "links", "size")

    def __init__(self, tag: str, up: _Node | None, attributes: str):
        self.tag, self.up, self.last, self.kind, self.kinds = tag, up, -1, tag, None
        self.cue, self.held, self.prose, self.around, self.links, self.size = None, 0, 0.0, 0.0, 0.0, 0.0
        if up:
            self.depth, self.mark, self.header, self.hidden, self.article, self.inner, self.good = up.depth + 1, up.mark, up.header, up.hidden, up.article, up.inner, up.good
        else:
            self.depth, self.mark, self.header, self.hidden, self.article, self.inner, self.good = 0, None, False, False, None, None, False
        zone, bad, article = tag in ZONES, 0.0, tag in ("article", "main")
        if tag == "header":
            self.header = self.header or not self.article
        if attributes and tag not in ("html", "body"):
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    if name == "class":
                        self.kind = f"{tag}.{value}"
                    for one in value.split():
                        words = {w.lower() for w in _WORD.findall(one)}
                        unwelcome = words & BAD_WORDS
                        if unwelcome:
                            bad = max(bad, 1.0 if words <= BAD_WORDS | NEUTRAL_WORDS else 0.5)
                        good = not unwelcome and not words.isdisjoint(GOOD_WORDS)
                        self.header = self.header or "header" in words and not good and not self.article
                        self.good = self.good or good
                elif name == "role":
                    zone = zone or value.lower() in ROLES
                    article = article or value.lower() in ("main", "article")
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.hidden = True
        if article:
            self.article, self.inner = self.article or self, self
        if zone or bad:
            self.mark = _Mark(self.mark, self, zone, bad)
        if up and tag in ITEMS:
            up.kinds = up.kinds or {}
            up.kinds[self.kind] = up.kinds.get(self.kind, 0) + 1


class Block:
    __slots__ = ("text", "node", "linked", "before")

    def __init__(self, text: str, node: _Node, linked: int, before: int):
        self.text, self.node, self.linked, self.before = text, node, linked, before


@lru_cache(maxsize=32)
def _raw_end(name: str) -> re.Pattern:
    """The end of an element of raw text; only letters of ASCII have two cases."""
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I | re.A)


def _container(at: _Node) -> _Node:
    while at.up and at.tag not in BLOCKS:
        at = at.up
    return at


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order; of each, the last block before it in the same container (or -1)."""
    found: list[Block] = []
    node, opened = _Node("", None, ""), {}
    parts: list[str] = []
    linked, links, dropped = 0, 0, 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                own = _container(node)
                parent = own.up and _container(own.up) or own
                found.append(Block(text, node, linked, parent.last))
                parent.last = len(found) - 1
            parts.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal node, links, dropped
        while node.up:
            tag, node = node.tag, node.up
            opened[tag] -= 1
            links -= tag == "a"
            dropped -= tag in DROPPED
            if tag == name:
                return

    # whatever starts before the last ">" ends somewhere, so that no search runs to the end in vain
    at, size, last = 0, len(html), html.rfind(">") + 1
    for m in iter(lambda: _TAG.search(html, at, last), None):
        if node.tag == "head" and html[at : m.start()].strip():
            close("head")  # text ends it, too
        if m.start() > at and not dropped:
            parts.append(html[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        if at == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = size  # an open comment hides the rest
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCKS:
                end()
            elif name in SPACES:
                parts.append(" ")
            if opened.get(name):
                close(name)
            continue
        if opened.get("head") and node.tag == "head" and name not in IN_HEAD and name not in ("head", "html"):
            close("head")  # its end may be left out
        if name in RAW:
            stop = _raw_end(name).search(html, at)
            at = stop.start() if stop else size
            continue
        if name in BLOCKS:
            end()
            if name in ENDS_P and opened.get("p"):
                close("p")
            if name == "li" and opened.get("li") and not _list_between(node):
                close("li")
        elif name in SPACES:
            parts.append(" ")
        if name in VOID or (m[3] or m[6] or "").endswith("/"):
            continue
        node = _Node(name, node, m[3] or m[6])
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
        dropped += name in DROPPED
    if node.tag == "head" and html[at:].strip():
        close("head")
    if at < size and not dropped:
        cut = _BROKEN.search(html, at)
        parts.append(html[at : cut.start() if cut else size])
    end()
    return found


def _list_between(node: _Node) -> bool:
    """Whether the innermost list starts inside the innermost item."""
    while node.up:
        if node.tag == "li":
            return False
        if node.tag in ("ul", "ol", "menu"):
            return True
        node = node.up
    return True


def _alone(article: _Node | None) -> bool:
    """Whether there is an article around, and it isn't one of several beside each other, as comments are."""
    return article is not None and (article.tag not in ITEMS or article.up is None or article.up.kinds[article.kind] < 2)


def _lies_in(node: _Node | None, article: _Node | None) -> bool:
    """Whether an element is in an article, of those around it that are nearest."""
    for _ in range(REACH):
        if node is None or article is None or node.inner is article:
            return node is not None and article is not None
        node = node.inner.up if node.inner else None
    return False


def _weigh(blocks: list[Block]) -> None:
    """How much each marked element counts. One that wraps the page's article, as forms do on many sites, doesn't."""
    marks: set[_Mark] = set()
    total = inside = 0.0
    heading = next((b for b in blocks if _container(b.node).tag == "h1"), None) or next((b for b in blocks if _container(b.node).tag in HEADINGS), None)
    article = heading.node.inner if heading else None
    while article and not _alone(article):
        article = article.up.inner
    for block in blocks:
        length, mark = len(block.text), block.node.mark
        mass = (length - block.linked) * (1.0 if length >= 60 or block.text[-1] in ".!?" else LITTLE)
        total += mass
        inside += mass if _lies_in(block.node, article) else 0.0
        if mark:
            mark.prose += mass
        while mark and mark not in marks:
            marks.add(mark)
            mark = mark.up
    mark = heading.node.mark if heading else None
    while mark:
        mark.held, mark = True, mark.up
    ordered = sorted(marks, key=lambda m: m.depth)
    for mark in reversed(ordered):
        if mark.up:
            mark.up.prose += mark.prose
    for mark in ordered:
        of = total if mark.held or not heading else inside if _lies_in(mark.node.up, article) else 0.0
        share = mark.prose / of if of else 0.0
        counts = min(1.0, max(0.0, (WRAPS[1] - share) / (WRAPS[1] - WRAPS[0])))
        up = mark.up
        mark.zoned = max(up.zoned if up else 0.0, mark.zone * counts)
        mark.bads = max(up.bads if up else 0.0, mark.bad * (counts if mark.held else 1.0))


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block of a page."""
    _weigh(blocks)
    places, most, around, seen_h1 = [], 0.0, 0.0, False
    for block in blocks:
        own = _container(block.node)
        parent = own.up and _container(own.up) or own
        above = parent.up and _container(parent.up) or parent
        length = len(block.text)
        prose = (length - block.linked) * (length >= 60 or block.text[-1] in ".!?")
        parent.prose += prose
        above.around += prose
        most, around = max(most, parent.prose), max(around, above.around)
        parent.links += block.linked
        parent.size += length
        places.append((own, parent, above))
        node = own
        for _ in range(REACH):
            node.held += 1
            if not node.up:
                break
            node = node.up
    rows, n = [], len(blocks)
    part = lambda some, all_of: some / all_of if all_of else 1.0
    ends = min(1.0, (n - 1) / 8)  # the few blocks of a short page are no margins
    for i, (block, (own, parent, above)) in enumerate(zip(blocks, places, strict=True)):
        node, text, length = block.node, block.text, len(block.text)
        words = _TEXT_WORD.findall(text.lower())
        cues = sum(w in CUES for w in words)
        share, heading = cues / max(1, len(words)), own.tag in HEADINGS
        under, alike, at = False, 0, own
        for _ in range(REACH):
            if at.cue and not (heading and at is parent):
                under = True
            if at.up and at.tag in ITEMS and at.held > 1:
                alike = max(alike, (at.up.kinds or {}).get(at.kind, 0))
            if not at.up:
                break
            at = at.up
        if heading or parent.cue is None and len(words) <= 3:  # what follows in the container stands under it
            parent.cue = cues > 0 and len(words) <= 5 and (own.tag != "h1" or seen_h1)
        elif parent.cue is None:
            parent.cue = False
        first = own.tag == "h1" and not seen_h1
        seen_h1 = seen_h1 or first
        zoned, bads = (node.mark.zoned, node.mark.bads) if node.mark else (0.0, 0.0)
        article, linked = _alone(node.article), min(1.0, block.linked / max(1, length))
        within = article and not under
        rows.append(
            (1.0, zoned, min(1.0, 2 * bads), max(0.0, 2 * bads - 1), node.header, node.hidden, article, node.good, own.tag in ("p", "pre", "blockquote"), heading, first, own.tag in ("li", "dd", "dt"), linked, min(1.0, length / 300), text[-1] in ".!?:;\"')…", length < 25)
            + (min(1.0, 4 * share), bool(_SIGN.search(text)), under, min(1.0, max(0, alike - 1) / 3), part(parent.prose, most), part(above.around, around), min(1.0, (parent.links - block.linked) / max(1.0, parent.size - length)), ends * max(0.0, 1 - i / 4), ends * max(0.0, 1 - (n - 1 - i) / 4))
            + (own.tag == "tr", within * (length < 25), within * linked, article * min(1.0, 4 * share))
        )
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


#: Marks of texts of generated pages: boilerplate, content.
_MARKS = "\ue000\ue001"


def generated_page(rng: random.Random) -> str:
    """A page whose texts begin with the mark of their label; its parts vary in markup, names, place and length."""
    syllables = "la the ti on er to ne sa ri ver mi da co pe lu gra st en".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(n):
        return " ".join(word() for _ in range(max(1, n))).capitalize() + rng.choice("...!?")

    def text(label, n, k=1):
        return _MARKS[label] + " ".join(sentence(rng.randint(1, n)) for _ in range(rng.randint(1, k)))

    def cue():
        return rng.choice(sorted(CUES))

    def plain():
        return rng.choice(("", f" class='{word()}'", f" class='{word()}-{word()}'", f" class='col-{rng.randint(1, 12)} {word()}'", f" id='{word()}{rng.randint(1, 99)}'"))

    def named(words):
        return plain() if rng.random() < 0.5 else f" {rng.choice(('class', 'class', 'id'))}='{rng.choice(('', '', word() + ' ', 'wrap '))}{rng.choice(sorted(words))}{rng.choice(('', '', '-box', '-wrapper', f'-{word()}'))}'"

    def links(n):
        return "".join(f"<li><a href='/{word()}'>{_MARKS[0]}{cue() if rng.random() < 0.3 else word()}</a></li>" for _ in range(n))

    def link_list():
        inner = f"<ul>{links(rng.randint(2, 9))}</ul>"
        if rng.random() < 0.07:
            return rng.choice((f"<nav{plain()}>{facts()}</nav>", f"<aside{plain()}>{facts()}</aside>", f"<div class='{rng.choice(sorted(BAD_WORDS))}'>{facts()}</div>"))
        return rng.choice((f"<nav{plain()}>{inner}</nav>", f"<div{named(BAD_WORDS)}>{inner}</div>", inner, f"<div{plain()}>" + " | ".join(f"<a href=x>{_MARKS[0]}{word()}</a>" for _ in range(rng.randint(2, 7))) + "</div>"))

    def facts():
        tag, item = rng.choice((("ul", "li"), ("ol", "li"), ("table", "tr"), ("dl", "dd")))
        inner = lambda: text(0, 4) if item != "tr" else f"<td>{_MARKS[0]}{word()}</td><td>{word()}</td>"
        return f"<{tag}>" + "".join(f"<{item}>{inner()}</{item}>" for _ in range(rng.randint(2, 6))) + f"</{tag}>"

    def titled(body, title):
        h = rng.choice(("h2", "h3", "h4", "p", "div"))
        return f"<{h}>{_MARKS[0]}{title}</{h}>{body}"

    def box(body, tags=("div", "div", "section")):
        tag = rng.choice(tags)
        return f"<{tag}{named(BAD_WORDS)}>{body}</{tag}>"

    def notice():
        body = f"<p>{text(0, 8)} {cue()} {sentence(5)} {cue()}</p>"
        return rng.choice((box(body), box(body + f"<button>{_MARKS[0]}OK</button>"), f"<div role='{rng.choice(sorted(ROLES))}'>{body}</div>", f"<dialog>{body}</dialog>", f"<div hidden>{text(0, 9)}</div>"))

    def advert():
        return rng.choice((box(text(0, 14)), box(titled(f"<p>{text(0, 14)}</p>", "Advertisement")), f"<div{named(BAD_WORDS)}><a href=x>{text(0, 9)}</a></div>", f"<aside>{text(0, 12)}</aside>"))

    def remarks():
        tag = rng.choice(("div", "li", "article", "section"))
        name = plain()
        item = lambda: f"<{tag}{name}><p>{_MARKS[0]}{word()} {rng.choice(('said', str(rng.randint(1, 28))))}</p><p>{text(0, 22, 3)}</p>{rng.choice(('', f'<a href=x>{_MARKS[0]}Reply</a>'))}</{tag}>"
        body = "".join(item() for _ in range(rng.randint(1, 6)))
        body = titled(body, rng.choice(("Comments", "Replies", f"{rng.randint(2, 40)} comments", cue(), word()))) if rng.random() < 0.8 else body
        return rng.choice((f"<section class='comments'>{body}</section>", box(body), box(body)))

    def teasers():
        name = plain()
        body = "".join(f"<div{name}><h4><a href=x>{_MARKS[0]}{sentence(6)}</a></h4><p>{text(0, 12)}</p></div>" for _ in range(rng.randint(2, 5)))
        body = rng.choice((body, f"<ul>{links(rng.randint(3, 8))}</ul>"))
        return rng.choice((f"<aside>{titled(body, 'Related')}</aside>", box(titled(body, cue())), box(titled(body, word()))))

    def foot():
        body = rng.choice((f"<p>{_MARKS[0]}&copy; {rng.randint(1999, 2026)} {sentence(5)}</p>", f"{text(0, 9)}", f"<p>{_MARKS[0]}Copyright {sentence(3)} All rights reserved.</p><ul>{links(4)}</ul>"))
        return rng.choice((f"<footer>{body}</footer>", f"<footer>{_MARKS[0]}&copy; {sentence(12)}</footer>", box(body)))

    def head():
        return rng.choice((f"<header{plain()}><p>{text(0, 4)}</p></header>", f"<div id='header'>{text(0, 3)}</div>", f"<div{plain()}><a href='/'>{_MARKS[0]}{word()}</a><p>{text(0, 5)}</p></div>", f"<div role='banner'>{text(0, 3)}</div>", f"<header><h1>{_MARKS[0]}{word()}</h1></header>"))

    def form():
        return f"<form{plain()}><p>{text(0, 5)}</p><label>{_MARKS[0]}{cue()}</label><input></form>"

    def paragraph():
        tag = rng.choice(("p", "p", "p", "p", "div", "blockquote", "pre"))
        inner = text(1, rng.choice((4, 12, 24)), rng.choice((1, 2, 6)))
        if rng.random() < 0.2:
            inner += f" <a href=x>{word()}</a> {sentence(6)}"
        chance = rng.random()
        if chance < 0.05:
            inner += f" {cue()} {sentence(5)}"
        elif chance < 0.08:
            inner = _MARKS[1] + rng.choice((f"Copyright {rng.randint(1990, 2026)} {sentence(3)}", "All rights reserved.", f"{cue().capitalize()} {cue()}.", f"{sentence(3)} {rng.randint(1990, 2026)}"))
        return f"<{tag}>{inner}</{tag}>"

    def table():
        cell = lambda: rng.choice((word(), str(rng.randint(1, 2100)), f"{word()} {word()}", str(round(rng.random(), 2))))
        n = rng.randint(2, 4)
        return "<table>" + "".join(f"<tr>{''.join(f'<td>{_MARKS[1]}{cell()}</td>' for _ in range(n))}</tr>" for _ in range(rng.randint(2, 8))) + "</table>"

    def link_items():
        tag = rng.choice(("ul", "ol"))
        return f"<{tag}>" + "".join(f"<li>{_MARKS[1]}<a href='{word()}'>{sentence(rng.randint(1, 5))[:-1]}</a></li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>"

    def terms():
        return "<dl>" + "".join(f"<dt>{_MARKS[1]}{word()}</dt><dd>{text(1, 8)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"

    def prose(n):
        out = []
        for _ in range(n):
            chance = rng.random()
            if chance < 0.1:
                out.append(f"<h{rng.randint(2, 4)}>{_MARKS[1]}{sentence(5)[:-1]}</h3>")
            elif chance < 0.17:
                out.append("<ul>" + "".join(f"<li>{text(1, 9)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif chance < 0.24:
                name = rng.choice((plain(), f" class='{rng.choice(sorted(BAD_WORDS))}-{word()}'", f" class='{word()}-{rng.choice(sorted(BAD_WORDS))}-{word()}'"))
                if rng.random() < 0.3:
                    out.append(rng.choice((table, link_items, terms))())
                    continue
                out.append(f"<{(t := rng.choice(('div', 'section')))}{name}>{''.join(paragraph() for _ in range(rng.randint(1, 3)))}</{t}>")
            else:
                out.append(paragraph())
            if rng.random() < 0.04:
                out.append(rng.choice((advert, form, teasers))())
        return "".join(out)

    if rng.random() < 0.1:  # little but the text
        return rng.choice((f"<p>{_MARKS[1]}{' '.join(word() for _ in range(rng.randint(1, 9)))}", _MARKS[1] + " ".join(word() for _ in range(rng.randint(1, 9))), prose(1), prose(3)))
    title = f"<h{rng.choice((1, 1, 2))}>{_MARKS[1]}{rng.choice((sentence(7)[:-1], sentence(7)))}</h1>" if rng.random() < 0.85 else ""
    inner = title + prose(rng.choice((0 if title else 1, 1, 2, 4, 8, 16)))
    chance = rng.random()
    if chance < 0.06:  # parts of sites that wrap what they hold
        inner = title + f"<fieldset{plain()}>{inner[len(title):]}</fieldset>"
    elif chance < 0.1:
        inner = title + f"<form{plain()}>{inner[len(title):]}</form>"
    opening, closing = rng.choice((("<article>", "</article>"), (f"<article{plain()}>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), (f"<div{plain()}>", "</div>"), (f"<div{plain()}><div{plain()}>", "</div></div>"), (f"<section{plain()}>", "</section>"), ("", "")))
    some = lambda parts, n: "".join(rng.choice(parts)() for _ in range(rng.randint(0, n)))
    page = some((link_list, head, notice, advert, head, link_list), 4) + opening + inner + closing + some((remarks, teasers, advert, form, foot, link_list, notice), 4) + (foot() if rng.random() < 0.7 else "")
    for _ in range(rng.choice((0, 0, 1, 2))):
        page = f"<div{plain()}>{page}</div>"
    if rng.random() < 0.15:
        tag = rng.choice(("form", "form", "form", "fieldset", "dialog", "div role='dialog'", "div class='modal'", "section class='popup'"))
        page = f"<{tag}>{page}</{tag.split()[0]}>"
    return f"<html><head><title>x</title></head><body>{page}</body></html>"


def _labelled(pages: int, seed: int) -> list[tuple[list[Block], np.ndarray, np.ndarray]]:
    """Blocks, features and labels of generated pages; the blocks of a page have one label each."""
    rng, made = random.Random(seed), []
    for _ in range(pages):
        blocks = blocks_of(generated_page(rng))
        labels = np.array([next((c == _MARKS[1] for c in b.text if c in _MARKS), False) for b in blocks], dtype=float)
        for b in blocks:
            b.text = b.text.translate({ord(c): None for c in _MARKS}) or "."
        if blocks:
            made.append((blocks, features(blocks), labels))
    return made


class Labeller:
    """Weights of the classifier, and how far costs and edges go."""

    def __init__(self, weights: np.ndarray, clip: float, smooth: float):
        self.weights, self.clip, self.smooth = weights, clip, smooth

    def costs(self, x: np.ndarray) -> list[float]:
        return np.clip(x @ self.weights, -self.clip, self.clip).tolist()

    def __call__(self, blocks: list[Block], x: np.ndarray) -> list[bool]:
        return min_cut(self.costs(x), _edges(blocks, self.smooth))


#: What is left of an edge between a block in a zone and one that isn't. Bounds of a block's cost, and strengths of edges, that are tried.
ACROSS = 0.25
CLIPS, SMOOTH = (4.0, 6.0, 8.0), (0.5, 1.0, 1.5, 2.0, 3.0, 4.0)


@lru_cache(maxsize=1)
def trained(pages: int = 600, seed: int = 8) -> Labeller:
    """Logistic regression of block labels on generated pages; bounds and strength by the cut's errors on further ones."""
    made = _labelled(pages, seed)
    x, y = np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made])
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
    checked, best = _labelled(pages // 3, seed + 1), None
    for clip in CLIPS:
        for smooth in SMOOTH:
            labeller = Labeller(w, clip, smooth)
            wrong = sum(int((np.array(labeller(b, f)) != (t > 0)).sum()) for b, f, t in checked)
            if best is None or wrong < best[0]:
                best = wrong, labeller
    return best[1]


#: What :func:`trained` finds, in the order of :data:`FEATURES`; a test holds it to that. So no application trains when it starts.
WEIGHTS = (
    -1.086, -3.355, -0.137, -6.275, -5.189, -4.0, 2.351, 2.22, 1.503, 3.256,
    1.552, 3.971, -3.502, 0.839, 0.848, -0.804, -3.175, -1.427, -4.027, -2.447,
    3.522, -0.461, -1.342, -2.084, -2.294, 4.421, 0.167, 2.039, 0.342,
)
LABELLER = Labeller(np.array(WEIGHTS), 4.0, 2.0)


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the minimum cut: whether each node is on the side of the content terminal.

    ``costs``: positive joins a node to the content terminal by that capacity, negative to the other. ``edges``: undirected
    (a, b, capacity). Maximum flow by shortest augmenting paths from each node that the source fills.
    """
    n = len(costs)
    supply, demand = [max(0.0, c) for c in costs], [max(0.0, -c) for c in costs]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    tiny = 1e-9
    closed = [False] * n  # nothing that can be reached from these has demand left, now or later
    for s in range(n):
        while supply[s] > tiny and not closed[s]:
            came, queue, goal = {s: -1}, [s], -1
            for x in queue:
                if demand[x] > tiny:
                    goal = x
                    break
                for y, w in room[x].items():
                    if w > tiny and y not in came and not closed[y]:
                        came[y] = x
                        queue.append(y)
            if goal < 0:
                for x in queue:
                    closed[x] = True
                break
            flow, y = min(supply[s], demand[goal]), goal
            while (x := came[y]) >= 0:
                flow, y = min(flow, room[x][y]), x
            y = goal
            while (x := came[y]) >= 0:
                room[x][y] -= flow
                room[y][x] += flow
                y = x
            supply[s] -= flow
            demand[goal] -= flow
    return closed  # what a content block with capacity left can reach


def _distance(a: _Node, b: _Node, most: int = 12) -> int:
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth and a.up:
            a = a.up
        elif b.up:
            b = b.up
        else:
            break
        steps += 1
    return steps


def _edges(blocks: list[Block], smooth: float) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours in page order, by their distance in the tree, and blocks that follow each other in a container.

    Less by what marks one of two and not the other.
    """
    marked = [(b.node.mark.zoned, b.node.mark.bads) if b.node.mark else (0.0, 0.0) for b in blocks]
    apart = lambda a, b: ACROSS ** max(abs(x - y) for x, y in zip(marked[a], marked[b], strict=True))
    edges = []
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, smooth * apart(i - 1, i) * min(1.0, 4 / 2 ** _distance(blocks[i - 1].node, block.node))))
        if 0 <= block.before < i - 1:
            edges.append((block.before, i, smooth / 2 * apart(block.before, i)))
    return edges


def main_text(html: str, labeller: Labeller) -> str:
    """The page's main text."""
    blocks = blocks_of(html)
    return "\n".join(b.text for b, keep in zip(blocks, labeller(blocks, features(blocks)), strict=True) if keep)


def extract_text(df: DataFrame, html: str = "html", text: str = "text", keep: list[str] | None = None, labeller: Labeller = LABELLER) -> DataFrame:
    """Adds ``text``: the main text of each page."""
    fresh(df.select(*(keep if keep is not None else df.columns)), text, "n_chars")

    def make():
        def one(value):
            found = main_text(text_of(value), labeller)
            return found, len(found)

        return one

    out = T.StructType([T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])
    return per_row(df, html, out, make, lambda row: 4 * row[1] + 64, keep)


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(load(spark, sf_dir, "pages"), keep=["page_id", "url"])
