"""Main text of web pages: boosted trees over the nodes of the page, decoded so that the choices fit together.

A page is read into a tree of block elements and runs of text. Boosted trees give each node the odds that it holds
main text, from the density of its subtree, the words of its attributes, its depth, its siblings and its ancestors.
The decoding takes the likeliest set of nodes in which nothing is kept inside something dropped. The trees are trained
on pages that this module writes itself, in many layouts, since there it is known which text is the article.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trajecta.llm.boost import Boosted
from trajecta.llm.common import blocks, released, small_batches

# Elements by how they are read. Elements that are named nowhere are read as inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What they hold is script, style, the page's title, a form's own value, or markup that is never shown as text.
RAW = frozenset("script style title textarea select iframe noframes noembed".split())
BLOCK = frozenset("html head body address article aside blockquote button caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Starting one of these ends an open element of its group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
#: An open paragraph ends where one of these starts.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An implied end doesn't reach beyond these.
SCOPE = frozenset("html body table td th div article section main aside nav header footer form ul ol dl blockquote figure #root".split())
#: Elements that are often left open; their end tags don't reach beyond SCOPE.
ENDED = frozenset("p li td tr dd dt".split())
KINDS = ["nav", "header", "footer", "aside", "article", "main", "section", "div", "p", "ul", "ol", "li", "form", "h1", "h2", "h3", "blockquote", "pre", "table", "tr", "td", "figure", "button", "body", "#text"]
GOOD = frozenset("article articles body blog content contents copy entry main page post posts story text hentry longform prose single richtext reading".split())
BAD = frozenset("ad ads adv advert adverts advertisement alert author aux banner bar bottom breadcrumb breadcrumbs byline captcha comment comments consent contact cookie cookies copyright discuss disqus disclaimer feedback follow foot footer form gdpr head header legal links login masthead menu meta modal more nav navbar navigation newsletter notice notification overlay pager pagination popular popup promo recommended recommendations rail related reply replies respond search share sharing sidebar side signup skip social sponsor sponsored subscribe tags teaser toolbar top topbar trending widget widgets".split())
HARD = frozenset("nav footer aside form button menu dialog".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
NONE_SHOWN = re.compile(r"display\s*:\s*none", re.I)
#: Attributes whose words tell what an element is for.
TELLING = frozenset(["class", "id", "role", "itemprop", "aria-label"])
BLANKS, ATTRIBUTE, EQUALS, BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
END_OF_RAW: dict[str, re.Pattern] = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
#: Depths beyond this count as this in the features; the tree itself is as deep as the page.
DEEPEST = 512


class Page:
    """Nodes in page order: tag, parent, depth, attribute words, own text (of text nodes) and the part of it in links."""

    def __init__(self):
        self.tag, self.parent, self.depth, self.good, self.bad, self.hidden, self.text, self.linked = ["#root"], [-1], [0], [0], [0], [0], [""], [0]

    def add(self, tag: str, parent: int, named: str = "", hidden: bool = False, text: str = "", linked: int = 0) -> int:
        words = {w.lower() for w in WORD.findall(named)} if named else ()
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.good.append(len(GOOD.intersection(words)))
        self.bad.append(len(BAD.intersection(words)))
        self.hidden.append(int(hidden))
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


class Tags:
    """Reads the tags of a source, each from where its name ends. Every character is looked at a fixed number of times."""

    def __init__(self, source: str):
        self.source, self.gone = source, set()

    def quote(self, mark: str, at: int) -> int:
        """The next such quote, or -1; that there is none is found out once."""
        if mark in self.gone:
            return -1
        place = self.source.find(mark, at)
        if place < 0:
            self.gone.add(mark)
        return place

    def read(self, at: int) -> tuple[int, str, bool]:
        """Where the tag ends, the words of its telling attributes, and whether it is hidden.

        A quote that is never closed, or only by the first quote of a later tag, doesn't reach beyond the tag's own `>`.
        """
        source, n = self.source, len(self.source)
        close = source.find(">", at)
        if close < 0:
            return n, "", False
        if source.find("=", at, close) < 0:
            return close + 1, "", " hidden" in source[at:close]
        named, hidden = [], False
        while True:
            at = BLANKS.match(source, at).end()
            if at >= n:
                return n, " ".join(named), hidden
            if source[at] == ">":
                return at + 1, " ".join(named), hidden
            m = ATTRIBUTE.match(source, at)
            name, at = m[0].lower(), m.end()
            m = EQUALS.match(source, at)
            if not m:
                hidden = hidden or name == "hidden"
                continue
            at = m.end()
            mark = source[at : at + 1]
            if mark in ('"', "'"):
                end = self.quote(mark, at + 1)
                inner = source.find(">", at + 1, end if end >= 0 else n)
                if inner >= 0 and (end < 0 or source[end + 1 : end + 2] not in (" ", "\t", "\n", "\r", "\f", "/", ">", "")):
                    return inner + 1, " ".join(named), hidden
                if end < 0:
                    return n, " ".join(named), hidden
                value, at = source[at + 1 : end], end + 1
            else:
                m = BARE.match(source, at)
                value, at = m[0], m.end()
            if name in TELLING:
                named.append(value)
            hidden = hidden or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(NONE_SHOWN.search(value))


def parse(source: str) -> Page:
    """The tree of block elements; markup that is never closed, or cut off, is read as browsers do, roughly. Takes time in
    proportion to the source, whatever it holds."""
    page, at, n = Page(), 0, len(source)
    stack = [0]
    # places in the stack, so that no end has to be looked for: of each tag, of SCOPE, and of what an implied end can't pass
    places: dict[str, list[int]] = {}
    scopes, walls = [0], [0]
    run: list[str] = []
    links = linked = 0
    tags = Tags(source)

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            run.append(piece)
            if links:
                linked += len(piece)

    def end_block() -> None:
        nonlocal linked
        if run:
            words = " ".join(html.unescape("".join(run)).split())
            if words:
                page.add("#text", stack[-1], text=words, linked=min(linked, len(words)))
            run.clear()
        linked = 0

    def enter(node: int, tag: str) -> None:
        at = len(stack)
        stack.append(node)
        places.setdefault(tag, []).append(at)
        if tag in SCOPE:
            scopes.append(at)
        if tag in SCOPE or tag not in ENDS and tag not in ("thead", "tbody"):
            walls.append(at)

    def leave(k: int) -> None:
        for node in stack[k:]:
            places[page.tag[node]].pop()
        del stack[k:]
        for held in (scopes, walls):
            while held[-1] >= k:
                held.pop()

    def last(tag: str) -> int:
        return held[-1] if (held := places.get(tag)) else 0

    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            text(source[at:])
            break
        text(source[at:begin])
        closing = source.startswith("/", begin + 1)
        m = NAME.match(source, begin + 1 + closing)
        if m is None:
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 4)
                at = end + 3 if end >= 0 else n
            elif source[begin + 1 : begin + 2] in ("!", "?", "/") or begin + 1 == n:
                end = source.find(">", begin + 1)
                at = end + 1 if end >= 0 else n
            else:  # no markup, just the sign
                text("<")
                at = begin + 1
            continue
        tag = m[0].lower()
        at, named, hidden = tags.read(m.end())
        if closing:
            if tag == "a":
                links = 0
            elif tag == "br":
                text(" ")
            elif tag in BLOCK:
                end_block()
                links = 0
                k = last(tag)
                if k and (tag not in ENDED or k >= scopes[-1]):
                    leave(k)
            continue
        if tag in RAW:
            m = END_OF_RAW[tag].search(source, at)
            at = m.end() if m else n
            text(" ")
        elif tag == "hr":
            end_block()
        elif tag in VOID:
            text(" " if tag == "br" else "")
        elif tag in BLOCK:
            end_block()
            links = 0
            ends = ENDS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            k = max(map(last, ends), default=0)
            if k and k >= walls[-1]:
                leave(k)
            enter(page.add(tag, stack[-1], named, hidden), tag)
        else:
            links = 1 if tag == "a" else links
    end_block()
    return page


NAMES = ["own_links", "length", "link_share", "words", "word_length", "stops", "commas", "upper", "symbols", "nodes", "density", "paragraphs", "items", "depth", "place", "before", "share", "siblings", "index", "alike", "good", "bad", "hidden", "good_above", "bad_above", "hard_above", "article_above", "hard_tag", "inside_bad", "parent_length", *(f"is_{k}" for k in KINDS), *(f"in_{k}" for k in KINDS)]


def features(page: Page) -> np.ndarray:
    """One row per node; see NAMES."""
    n = len(page.tag)
    parent = page.parent
    length, linked, words, stops, commas, upper, symbols = (np.zeros(n) for _ in range(7))
    nodes, paragraphs, items = np.ones(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        t = page.text[k]
        if t:
            length[k], linked[k], words[k] = len(t), page.linked[k], t.count(" ") + 1
            stops[k], commas[k] = t.count(".") + t.count("!") + t.count("?"), t.count(",")
            upper[k] = t[0].isupper()
            symbols[k] = t.count("|") + t.count("©") + t.count("·") + t.count("»") + t.count("/")
            paragraphs[k] = page.tag[parent[k]] in ("p", "blockquote", "pre") or len(t) > 80
        items[k] = page.tag[k] == "li"
    place = np.cumsum(length) - length
    total = max(1.0, float(length.sum()))
    children = np.zeros(n)
    index, alike = np.zeros(n), np.zeros(n)
    same: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        index[k] = children[parent[k]]
        children[parent[k]] += 1
        same[parent[k], page.tag[k]] = same.get((parent[k], page.tag[k]), 0) + 1
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for a in (length, linked, words, stops, commas, symbols, nodes, paragraphs, items):
            a[p] += a[k]
        if p:
            place[p] = min(place[p], place[k]) if length[k] else place[p]
    above = np.zeros((n, 4))
    for k in range(1, n):
        p = parent[k]
        above[k] = above[p]
        above[k, 0] += page.good[p]
        above[k, 1] += page.bad[p]
        above[k, 2] += page.tag[p] in HARD
        above[k, 3] += page.tag[p] in ("article", "main")
        alike[k] = same[parent[k], page.tag[k]]
    up = np.array([max(0, p) for p in parent])
    good, bad, hidden = (np.array(x, float) for x in (page.good, page.bad, page.hidden))
    kinds = np.array([KINDS.index(t) if t in KINDS else -1 for t in page.tag])
    own = kinds[:, None] == np.arange(len(KINDS))
    hard = np.array([t in HARD for t in page.tag], float)
    some = np.maximum(1, length)
    columns = [
        np.array(page.linked, float), np.log1p(length), linked / some, np.log1p(words), length / np.maximum(1, words), stops / np.maximum(1, words), commas / np.maximum(1, words), upper, symbols / np.maximum(1, words),
        np.log1p(nodes), np.log1p(length / nodes), paragraphs, items, np.minimum(page.depth, DEEPEST).astype(float), place / total, np.log1p(place), length / total, children[up], index, alike,
        good, bad, hidden, above[:, 0], above[:, 1], above[:, 2], above[:, 3], hard, bad[up] + hard[up], np.log1p(length[up]),
    ]
    return np.concatenate([np.stack(columns, axis=1), own, own[up]], axis=1)


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest choice in which a kept node has only kept ancestors.

    The odds hold given that the node's parent is kept, so a dropped node settles all that is below it. A node weighs
    by its own text, so that long paragraphs outvote the boxes around them; the root is always kept.
    """
    n = len(page.tag)
    weight = np.array([1.0 + min(4.0, len(t) / 100) for t in page.text])
    keep = (-np.logaddexp(0, -odds) * weight).tolist()
    drop = (-np.logaddexp(0, odds) * weight).tolist()
    for k in range(n - 1, 0, -1):
        keep[page.parent[k]] += max(keep[k], drop[k])
    out = np.zeros(n, bool)
    out[0] = True
    for k in range(1, n):
        out[k] = out[page.parent[k]] and keep[k] > drop[k]
    return out


def main_text(page: Page, kept: np.ndarray) -> str:
    return " ".join(t for t, k in zip(page.text, kept, strict=True) if k and t)


# --- training pages -------------------------------------------------------------------------------------------------


class Layout:
    """Writes one page in a random layout; text of the article is bracketed by the marks, which the trainer reads."""

    def __init__(self, rng: random.Random):
        self.r = rng
        parts = ["".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiouéä") for _ in range(1)) + rng.choice(["", "n", "s", "r", "tion", "ch"]) for _ in range(40)]
        self.vocabulary = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 1, 2, 2, 3]))) for _ in range(150)]
        self.named = rng.random() < 0.75  # else boxes have no telling attributes
        self.shout = rng.random() < 0.12

    def words(self, low: int, high: int) -> str:
        out = [self.r.choice(self.vocabulary) for _ in range(self.r.randint(low, high))]
        if self.shout:
            return " ".join(w.upper() + self.r.choice(["!!", ".!!", "***"]) for w in out)
        for k in range(len(out)):
            if k == 0 or out[k - 1].endswith("."):
                out[k] = out[k].capitalize()
            if self.r.random() < 0.18:
                out[k] += self.r.choice([".", ".", ","])
        if self.r.random() < 0.08:
            return " | ".join(out)
        return " ".join(out) + self.r.choice([".", ".", ""])

    def box(self, tags: list[str], names: list[str], inner: str) -> str:
        tag = self.r.choice(tags)
        name = self.r.choice(names) if self.named and names and self.r.random() < 0.85 else self.r.choice(["", "", "x1", "col-6", "row"])
        if name and self.r.random() < 0.5:  # as site builders decorate such names
            name = self.r.choice(["", "js-", "c-", "site-", "block__", "wp-"]) + name + self.r.choice(["", "-wrap", "__inner", "Box", "-2", " clearfix", " is-open"])
        attribute = f' {self.r.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, low: int, high: int, word: int = 2) -> str:
        items = [f'<a href="/{self.r.choice(self.vocabulary)}">{self.words(1, word)}</a>' for _ in range(self.r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else self.r.choice([" ", " | ", ""]).join(items)

    def nav(self) -> str:
        return self.box(["nav", "nav", "div", "ul"], ["nav", "menu", "navbar", "main-nav", "site-navigation", "breadcrumbs", "topbar"], self.links(3, 9))

    def header(self) -> str:
        return self.box(["header", "header", "div"], ["header", "masthead", "site-header", "top"], self.r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 4)}</div>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(3, 9)}</p>"]) + (self.nav() if self.r.random() < 0.5 else ""))

    def advert(self) -> str:
        return self.box(["div", "div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "banner", "promo", "ad-slot"], self.r.choice([self.words(2, 14), f"<p>{self.words(3, 25)}</p>", f'<a href="/">{self.words(2, 8)}</a>', f"{self.words(2, 10)}<br>{self.words(2, 10)}"]))

    def notice(self) -> str:
        return self.box(["div", "div", "section", "aside"], ["cookie", "cookie-notice", "consent", "gdpr-banner", "notice", "alert", "newsletter"], f"<p>{self.words(5, 30)}</p>" + self.r.choice(["", "<button>OK</button>", f'<a href="/">{self.words(1, 2)}</a>']))

    def sidebar(self) -> str:
        inner = "".join(self.r.choice([f"<h3>{self.words(1, 3)}</h3>{self.links(3, 7, 6)}", f"<p>{self.words(8, 40)}</p>", f"<div>{self.words(3, 20)}</div>", self.advert()]) for _ in range(self.r.randint(1, 3)))
        return self.box(["aside", "aside", "div"], ["sidebar", "side", "widget-area", "related", "rail"], inner)

    def form(self) -> str:
        return self.box(["form", "form", "div"], ["search", "signup", "contact-form", "login", "newsletter"], f"<form><label>{self.words(1, 4)}</label><input name=q><p>{self.words(3, 15)}</p><button>{self.words(1, 2)}</button></form>")

    def comments(self) -> str:
        one = lambda: self.box(["div", "li", "article"], ["comment", "reply", "comment-body"], f"<p>{self.words(1, 2)}</p><p>{self.words(5, 50)}</p>")
        return self.box(["div", "section", "ol"], ["comments", "comment-list", "discussion", "responses", "respond"], f"<h3>{self.words(1, 2)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5))))

    def footer(self) -> str:
        return self.box(["footer", "footer", "footer", "div"], ["footer", "site-footer", "copyright", "legal", "bottom"], self.r.choice([f"&copy; {self.words(1, 2)} &middot; {self.words(3, 20)}", f"<p>&copy; {self.words(2, 20)}</p>", self.links(2, 6), f"{self.words(3, 12)}", f"<p>{self.words(5, 30)}</p>{self.links(2, 5)}"]))

    def paragraph(self) -> str:
        text = self.words(*self.r.choice([(1, 3), (3, 15), (15, 60), (40, 140), (60, 300)]))
        if self.r.random() < 0.2:
            text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(2, 20)}'
        if self.r.random() < 0.2:
            style = self.r.choice(["b", "strong", "em", "i", "span", "small"])
            words = text.split(" ")
            k = self.r.randint(0, len(words) - 1)
            text = " ".join([*words[:k], f"<{style}>{words[k]}", *words[k + 1 :]]) + f"</{style}>" + self.r.choice(["", "", "<br>", f"<br>{self.words(2, 20)}"])
        mark = f"\x01{text}\x02"
        kind = self.r.random()
        if kind < 0.72:
            return f"<p>{mark}</p>" if self.r.random() < 0.8 else f"<p>{mark}"
        if kind < 0.8:
            return f"<h{self.r.choice('234')}>\x01{self.words(1, 8)}\x02</h2><p>{mark}</p>"
        if kind < 0.87:
            return f"<{self.r.choice(['ul', 'ol'])}>" + "".join(f"<li>\x01{self.words(2, 20)}\x02</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{self.r.choice(['', '<p>'])}{mark}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>\x01{self.words(1, 5)}\x02</td><td>\x01{self.words(1, 5)}\x02</td></tr>" for _ in range(self.r.randint(2, 4))) + "</table>"
        if kind < 0.97:
            return f"<pre>{mark}</pre>"
        return f"<div>{mark}</div>"

    def article(self) -> str:
        title = f"<h1>\x01{self.words(2, 12)}\x02</h1>" if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        inner = [title]
        for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 10, 16])):
            inner.append(self.paragraph())
            if self.r.random() < 0.06:
                inner.append(self.r.choice([self.advert, self.sidebar, self.notice, self.form])())
        if self.r.random() < 0.15:
            inner.append(self.box(["div", "ul"], ["share", "social", "tags", "related", "post-meta"], self.links(2, 5)))
        if self.r.random() < 0.08:
            inner.append(self.comments())
        body = "".join(inner)
        if self.r.random() < 0.15:
            body = f"<div>{body}</div>"
        kind = self.r.random()
        if kind < 0.5:
            return self.box(["article"], ["post", "article", "story", "entry"], body) if self.r.random() < 0.5 else f"<article>{body}</article>"
        if kind < 0.65:
            return f"<main>{body}</main>"
        if kind < 0.95:
            return self.box(["div", "section", "div"], ["content", "main", "post-content", "entry-content", "article-body", "story-text"], body)
        return body

    def page(self) -> str:
        maybe = lambda p, f: f() if self.r.random() < p else ""
        before = [maybe(0.4, self.header), maybe(0.75, self.nav), maybe(0.25, self.notice), maybe(0.5, self.advert), maybe(0.1, self.form), maybe(0.12, self.sidebar)]
        after = [maybe(0.3, self.sidebar), maybe(0.3, self.comments), maybe(0.2, self.form), maybe(0.2, self.advert), maybe(0.1, self.notice), maybe(0.85, self.footer)]
        self.r.shuffle(before)
        middle = self.article()
        if self.r.random() < 0.25:
            middle = self.box(["div", "main", "section"], ["container", "wrapper", "layout", "page"], middle + (after.pop(0)))
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>" + "".join(before) + middle + "".join(after) + "</body></html>"
        if self.r.random() < 0.3:  # end tags that writers leave out
            page = re.sub(r"</(?:p|li|b|em|i|span|strong|td|tr|a)>", lambda m: "" if self.r.random() < 0.15 else m[0], page)
        return page[: -self.r.randint(1, 60)] if self.r.random() < 0.1 else page


def labelled(page: Page) -> np.ndarray:
    """1 for nodes that hold article text; takes the marks out of the texts."""
    out = np.zeros(len(page.tag))
    for k, t in enumerate(page.text):
        if "\x01" in t:
            out[k] = 1
        if t:
            page.text[k] = " ".join(t.replace("\x01", "").replace("\x02", "").split())
    for k in range(len(out) - 1, 0, -1):
        out[page.parent[k]] = max(out[page.parent[k]], out[k])
    return out


PAGES = 1000


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = 20) -> Boosted:
    """Trees fitted on so many written pages; the same for the same arguments."""
    rows, marks = [], []
    for k in range(pages):
        page = parse(Layout(random.Random(seed * 100_003 + k)).page())
        marked = labelled(page)
        # only nodes within kept ones are ever asked about
        asked = [j for j in range(1, len(marked)) if marked[page.parent[j]]]
        marks.append(marked[asked])
        rows.append(features(page)[asked])
    model = Boosted()
    model.fit(np.concatenate(rows), np.concatenate(marks))
    return model


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row. A null or empty html, or one without main text, gives an empty text.
    Rows that repeat a page_id each get a row; other columns are ignored."""
    fitted = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 3_000_000, "html"):
            parsed = [parse(h) if h else Page() for h in batch.column(2).to_pylist()]
            odds = fitted.log_odds(np.concatenate([features(p) for p in parsed]))
            texts, at = [], 0
            for page in parsed:
                n = len(page.tag)
                texts.append(main_text(page, decode(page, odds[at : at + n])))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(released(run), "page_id long, url string, text string, n_chars long")
