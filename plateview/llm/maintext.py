"""Main text of HTML pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements. Trees of ``pyspark.ml`` tell from tag, attribute tokens, density of
the subtree, depth and siblings how likely a node holds main text. Decoding chooses for the whole tree at
once: a node is either dropped with all below it, or open, and its children choose; so no text is kept under a
dropped ancestor. The training nodes come from pages written by a rule and from a bounded sample of the given
pages whose markup names its parts.
"""

from __future__ import annotations

import html as markup
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from plateview.sources.scratch import stored

RULE_PAGES = 1_500           # training pages written by rule
FIT_PAGES = 500              # training pages taken from the table, at most
TREES, DEPTH = 24, 5

# Elements that end a block of text, and those whose content is never text.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select
summary table tbody td textarea tfoot th thead tr ul""".split())
HIDDEN = frozenset("script style template noscript iframe object svg math head title textarea select button noembed noframes audio video canvas".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript".split())
# What may stand in a head; anything else ends it, as its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What a start tag closes, up to the elements that shield it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
SHIELD = frozenset("ul ol dl table select html body".split())
NO_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hgroup hr main menu nav ol p pre section summary table ul""".split())

TAGS = {name: i for i, group in enumerate([
    "article main", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6 hgroup", "nav menu dir", "header", "footer", "aside", "form fieldset legend",
    "ul ol dl", "li dt dd", "table tbody thead tfoot tr", "td th caption", "blockquote pre address figure figcaption"]) for name in group.split()}
OTHER_TAG, N_TAGS = 16, 17
# Words in class, id and role that speak for a part of a page.
PARTS = {word: i for i, group in enumerate([
    "content article post entry main body story text blog page single hentry articlebody maincontent prose",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topnav",
    "footer foot copyright legal colophon bottom contentinfo",
    "header masthead banner logo topbar head site branding",
    "sidebar aside side rail widget widgets complementary column secondary",
    "ad ads advert adverts advertisement sponsor sponsored promo promoted promotion dfp adsense banners commercial",
    "comment comments disqus reply replies respond discussion commentlist reader responses",
    "cookie cookies consent notice notices gdpr alert alerts popup modal overlay message warning newsletter subscribe signup subscription announcement paywall",
    "share sharing social related recommended recommendations trending popular tags meta byline more also",
    "form search login register contact field input",
]) for word in group.split()}
N_PARTS = 10
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|/?[a-zA-Z][^>]*>)""")
_PAIRED = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noembed|noframes|noscript)\b.*?(?:</\1|\Z)
|<(/?)(template|object|svg|math|select|button|audio|video|canvas)(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*)>""".replace("\n", ""), re.I | re.S)
_MORE_SPACE = re.compile(r"\s+")
_parts_seen: dict[str, tuple[int, bool]] = {}


def _parts(attributes: str) -> tuple[int, bool]:
    """Bits of the parts that the attribute words speak for, and whether a rule page marks main text."""
    known = _parts_seen.get(attributes)
    if known is None:
        bits, main = 0, False
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1].lower() == "data-main":
                main = True
                continue
            for word in _TOKEN.findall(m[2] or m[3] or m[4] or ""):
                part = PARTS.get(word.lower())
                if part is not None:
                    bits |= 1 << part
        known = bits, main
        if len(_parts_seen) >= 20_000:
            _parts_seen.clear()
        _parts_seen[attributes] = known
    return known


def _unclosed(html: str) -> set[int]:
    """Where the start tags of hidden elements stand that no end tag matches."""
    open_: dict[str, list[int]] = {}
    for m in _PAIRED.finditer(html):
        if not m[3]:
            continue
        starts = open_.setdefault(m[3].lower(), [])
        if not m[2]:
            if not m[4].endswith("/") or m[3].lower() in BLOCKS:
                starts.append(m.start())
        elif starts:
            starts.pop()
    return {at for starts in open_.values() for at in starts}


class Page:
    """Block elements in page order, and runs of text with the element that holds them."""

    __slots__ = ("tag", "parent", "stop", "parts", "main", "children", "run_node", "run_text", "run_link")

    def __init__(self, html: str):
        self.tag, self.parent, self.parts, self.main, self.stop = [OTHER_TAG], [-1], [0], [False], [0]
        self.run_node, self.run_text, self.run_link = [], [], []
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]     # open elements and their nodes; inline ones share their block's
        pieces: list[str] = []
        linked, hidden, links, paragraphs, n = 0, 0, 0, 0, len(html)
        unclosed: set[int] | None = None
        loose: list[int] = []       # depths of buttons and selects without an end tag; the next block ends them

        def flush() -> None:
            nonlocal pieces, linked
            if pieces:
                text = "".join(pieces)
                text = " ".join((markup.unescape(text) if "&" in text else text).split())
                if text:
                    self.run_node.append(stack[-1][1])
                    self.run_text.append(text)
                    self.run_link.append(min(linked, len(text)))
                pieces, linked = [], 0

        def close(depth: int) -> None:
            nonlocal hidden, links, paragraphs
            flush()
            while len(stack) > depth:
                name, node = stack.pop()
                if name in HIDDEN:
                    hidden -= 1
                elif name == "a":
                    links -= 1
                elif name == "p":
                    paragraphs -= 1
                if node != stack[-1][1]:
                    self.stop[node] = len(self.tag)

        def text(low: int, high: int) -> None:
            nonlocal linked
            if hidden and stack[-1][0] == "head" and html[low:high].strip():
                close(len(stack) - 1)
            if high > low and not hidden:
                pieces.append(html[low:high])
                if links:
                    linked += high - low

        at = 0
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                text(at, n)
                break
            text(at, m.start())
            at = m.end()
            if m[1]:
                end = html.find("-->", m.start() + 2)
                at = n if end < 0 else max(end + 3, at)
                continue
            if m[2]:
                end = html.find("]]>", at) if html.startswith("[CDATA[", at) else html.find(">", at)
                at = n if end < 0 else end + (3 if html[end] == "]" else 1)
                continue
            if m[4] is None:        # a quote is left open: the tag ends at the next >
                body = m[0][1:-1]
                closing, name, rest = body[0] == "/", re.split(r"[\s/>]", body.lstrip("/"), maxsplit=1)[0].lower(), ""
            else:
                closing, name, rest = m[3] == "/", m[4].lower(), m[5]
            block = name in BLOCKS
            while loose and loose[-1] >= len(stack):
                loose.pop()
            if closing:
                if name == "p" and not paragraphs:
                    flush()
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        if block:
                            close(i)
                        else:
                            # An inline element ends alone; blocks opened in it stay open.
                            if any(stack[j][0] in BLOCKS for j in range(i + 1, len(stack))):
                                gone, node = stack[i]
                                stack[i] = ("", node)
                                links -= gone == "a"
                                hidden -= gone in HIDDEN
                            else:
                                held = stack[i:]
                                del stack[i:]
                                for gone, _ in held:
                                    links -= gone == "a"
                                    hidden -= gone in HIDDEN
                        break
                    if stack[i][0] in SHIELD and not block:
                        break
                else:
                    if block:
                        flush()
                continue
            if stack[-1][0] == "head" and name not in IN_HEAD:
                close(len(stack) - 1)
            if name in NO_P and loose:
                close(loose.pop(0))
                loose.clear()
            if name == "br":
                if not hidden:
                    pieces.append(" ")
                continue
            if name in ENDS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ENDS[name]:
                        close(i)
                    elif stack[i][0] in SHIELD:
                        break
            if paragraphs and name in NO_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
            if name in RAW and not rest.rstrip().endswith("/"):
                end = re.compile(f"</{name}", re.I).search(html, at)
                stop = html.find(">", end.start()) if end else -1
                if block:
                    flush()
                at = n if stop < 0 else stop + 1
                continue
            ends = True
            if name in HIDDEN and name not in RAW and name != "head":
                if unclosed is None:
                    unclosed = _unclosed(html)
                ends = m.start() not in unclosed
            if name in VOID or not (ends or block):
                if block:
                    flush()
                continue
            if block:
                flush()
                parts, main = _parts(rest) if rest else (0, False)
                node = len(self.tag)
                self.tag.append(TAGS.get(name, OTHER_TAG))
                self.parent.append(stack[-1][1])
                self.parts.append(parts)
                self.main.append(main)
                self.stop.append(0)
            else:
                node = stack[-1][1]
            if name in HIDDEN:
                hidden += 1
            elif name == "a":
                links += 1
            elif name == "p":
                paragraphs += 1
            if not rest.endswith("/") or block:
                if not ends:
                    loose.append(len(stack))
                stack.append((name, node))
            elif name in HIDDEN:
                hidden -= 1
            elif name == "a":
                links -= 1
        close(1)
        flush()
        self.stop[0] = len(self.tag)


def features(pages: list[Page]) -> np.ndarray:
    """A row for every node of the pages, in order."""
    sizes = np.array([len(p.tag) for p in pages])
    base = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    page = np.repeat(np.arange(len(pages)), sizes)
    tag = np.concatenate([p.tag for p in pages])
    parts = np.concatenate([p.parts for p in pages])
    parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, base)])
    parent[base] = base
    stop = np.concatenate([np.array(p.stop) + b for p, b in zip(pages, base)])
    # Own flags and those of all ancestors; parents come before their children.
    flags = (parts << N_TAGS) | (1 << tag)
    above, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
    level = np.flatnonzero(np.isin(np.arange(n), base))
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(n + 1))
    while len(level):
        count = first[level + 1] - first[level]
        child = order[np.repeat(first[level] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        child = child[parent[child] != child]
        above[child] = above[parent[child]] | flags[parent[child]]
        depth[child] = depth[parent[child]] + 1
        level = child
    # Text per node, and per subtree by differences of sums along page order.
    node = np.concatenate([np.array(p.run_node, np.int64) + b for p, b in zip(pages, base)])
    texts = [t for p in pages for t in p.run_text]
    length = np.array([len(t) for t in texts], float)
    link = np.array([x for p in pages for x in p.run_link], float)
    words = np.array([t.count(" ") + 1 for t in texts], float)
    points = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts], float)
    place = np.arange(n)

    def own(values):
        return np.bincount(node, values, n) if len(node) else np.zeros(n)

    def below(values):
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[stop] - total[place]

    own_length = own(length)
    all_length, all_link, all_words, all_points = below(own_length), below(own(link)), below(own(words)), below(own(points))
    paragraphs = below((tag == TAGS["p"]) & (own_length > 0))
    nodes = stop - place
    whole = np.maximum(all_length[base][page], 1.0)
    before = np.concatenate([[0.0], np.cumsum(own_length)])
    siblings = (first[parent + 1] - first[parent]).astype(float)
    number = np.empty(n)
    number[order] = np.arange(n) - first[parent[order]]
    alike = np.zeros(n)
    key = parent * 32 + tag
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    alike = counts[which] / np.maximum(siblings, 1)

    def beside(step):
        out = np.zeros(n)
        i = np.arange(max(n - 1, 0))
        a, b = order[i], order[i + 1]
        same = parent[a] == parent[b]
        out[(b if step < 0 else a)[same]] = all_length[(a if step < 0 else b)[same]]
        return out

    bits = np.arange(N_TAGS + N_PARTS)
    mine = (flags[:, None] >> bits) & 1
    ancestors = (above[:, None] >> np.array([TAGS[t] for t in ("article", "section", "nav", "header", "footer", "aside", "form", "ul", "table")]
                                             + list(range(N_TAGS, N_TAGS + N_PARTS)))) & 1
    # A part's word on a node counts for itself and for all it holds.
    numbers = np.stack([
        depth, np.log1p(all_length), np.log1p(own_length), all_link / np.maximum(all_length, 1), all_link[parent] / np.maximum(all_length[parent], 1),
        np.log1p(all_words), all_points / np.maximum(all_words, 1), all_length / nodes, np.log1p(nodes), all_length / whole,
        all_length[parent] / whole, np.log1p(paragraphs), siblings, number, alike, np.log1p(beside(-1)), np.log1p(beside(1)),
        (before[place] - before[base][page]) / whole, np.log1p(whole)], axis=1)
    return np.concatenate([mine, ancestors, numbers], axis=1).astype(np.float32)


# --- training pages --------------------------------------------------------------------------

def rule_page(seed: int) -> str:
    """A page of random layout and words; elements with main text carry ``data-main``, which no feature sees."""
    rng = random.Random(seed)
    letters = rng.choice(["etaoinshrdlu", "enisratdhulcg", "esaintrulodcp", "eaosrnidlctum"])

    def words(low, high):
        out = []
        for _ in range(rng.randint(low, high)):
            out.append("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", "", "", ",", "."]))
        return (" ".join(out)).capitalize() + rng.choice([".", ".", ".", ""])

    def links(count):
        return [f'<a href="/{i}">{words(1, 3)}</a>' for i in range(count)]

    def main(name="p", low=1, high=90):
        inner = words(low, high)
        if rng.random() < 0.2:
            inner = f"{inner} <a href='#'>{words(1, 4)}</a> {words(1, 20)}"
        if rng.random() < 0.1:
            inner = f"<b>{words(1, 12)}<br>" + inner
        return f'<{name} data-main="1">{inner}' + (f"</{name}>" if rng.random() < 0.9 or name != "p" else "")

    def any_of(*forms):
        return rng.choice(forms)

    def menu():
        body = "<ul>" + "".join(f"<li>{x}</li>" for x in links(rng.randint(3, 9))) + "</ul>"
        return any_of(f"<nav>{body}</nav>", f'<div class="menu">{body}</div>', f'<div id="main-nav">{body}</div>', f'<nav class="site-nav">{"".join(links(5))}</nav>',
                      f'<div class="breadcrumb">{" / ".join(links(3))}</div>', f'<ul class="navbar">{"".join(f"<li>{x}" for x in links(5))}</ul>')

    def advert():
        return any_of(f'<div class="ad">{words(3, 25)}</div>', f'<div class="ad-banner"><p>{words(3, 40)}</p></div>', f'<div id="sponsored">{links(1)[0]} {words(3, 20)}</div>',
                      f'<aside class="advert"><p>{words(4, 40)}</p></aside>', f'<section class="promo"><h3>{words(2, 5)}</h3><p>{words(5, 30)}</p></section>',
                      f'<div class="advertisement">{words(3, 40)}</div>')

    def notice():
        return any_of(f'<div class="cookie-notice"><p>{words(5, 40)}</p><button>{words(1, 2)}</button></div>', f'<div id="consent">{words(5, 30)}</div>',
                      f'<div class="alert" role="alert">{words(4, 25)}</div>', f'<div class="newsletter"><h4>{words(2, 5)}</h4><p>{words(5, 30)}</p></div>',
                      f'<div class="notice">{words(4, 40)}</div>', f'<section class="subscribe"><p>{words(4, 30)}</p></section>')

    def form():
        return any_of(f'<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>', f'<form class="search"><p>{words(1, 8)}</p><input type="text"></form>',
                      f'<form id="contact"><div>{words(2, 20)}</div><select><option>{words(1, 2)}<option>{words(1, 2)}</select></form>')

    def comments():
        each = "".join(any_of(f'<div class="comment"><p>{words(2, 60)}</p></div>', f'<li class="comment"><b>{words(1, 2)}</b><p>{words(2, 60)}</p></li>')
                       for _ in range(rng.randint(1, 7)))
        return any_of(f'<section class="comments"><h2>{words(1, 3)}</h2>{each}</section>', f'<div id="comments"><h3>{words(1, 3)}</h3>{each}</div>',
                      f'<div id="disqus_thread">{each}</div>', f'<ul class="reader-comments">{each}</ul>', f'<ol class="commentlist">{each}</ol>')

    def sidebar():
        inner = "".join(any_of(f"<h3>{words(1, 4)}</h3><p>{words(5, 50)}</p>", f'<div class="widget"><ul>{"".join(f"<li>{x}</li>" for x in links(4))}</ul></div>',
                               f'<div class="widget"><p>{words(8, 60)}</p></div>', "<p>" + words(6, 50) + "</p>") for _ in range(rng.randint(1, 4)))
        return any_of(f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div id="sidebar-right">{inner}</div>', f'<div class="side">{inner}</div>',
                      f'<aside class="related"><h4>{words(1, 3)}</h4>{inner}</aside>', f'<div class="related-posts">{inner}</div>')

    def head():
        return any_of(f"<header><h1>{words(1, 4)}</h1></header>", f'<div class="header"><p>{words(1, 10)}</p></div>', f'<header class="site-header">{words(1, 6)}{menu()}</header>',
                      f'<div id="masthead">{words(1, 5)}</div>', f"<header>{menu()}</header>", f'<div class="banner"><p>{words(2, 12)}</p></div>')

    def foot():
        return any_of(f"<footer>&copy; {words(1, 20)}</footer>", f'<div class="footer"><p>{words(2, 30)}</p></div>', f'<div id="footer">{" ".join(links(4))} {words(1, 15)}</div>',
                      f'<footer><p>{words(3, 30)}</p><ul>{"".join(f"<li>{x}</li>" for x in links(3))}</ul></footer>')

    body = [main("h1", 1, 12)] if rng.random() < 0.85 else []
    for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 12])):
        kind = rng.random()
        if kind < 0.78:
            body.append(main())
        elif kind < 0.84:
            body.append(main(rng.choice(["h2", "h3"]), 1, 8))
        elif kind < 0.9:
            body.append("<ul>" + "".join(main("li", 1, 25) for _ in range(rng.randint(2, 6))) + "</ul>")
        elif kind < 0.93:
            body.append(f'<blockquote data-main="1">{words(4, 40)}</blockquote>')
        elif kind < 0.95:
            body.append("<table>" + "".join("<tr>" + main("td", 1, 5) + main("td", 1, 5) + "</tr>" for _ in range(3)) + "</table>")
        else:
            body.append(main("div", 5, 60))
    if not body:
        body = [main()]
    for make, chance in ((advert, 0.3), (sidebar, 0.12), (form, 0.1), (notice, 0.12)):
        if rng.random() < chance:
            body.insert(rng.randint(0, len(body)), make())
    if rng.random() < 0.15:
        body.append(any_of(f'<div class="share">{" ".join(links(3))}</div>', f'<div class="tags">{" ".join(links(4))}</div>', comments(), f"<footer>{words(2, 12)}</footer>"))
    inner = "".join(body)
    if rng.random() < 0.3:
        inner = f"<div>{inner}</div>"
    box = any_of(*[f"<article>{inner}</article>"] * 3, f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div id="content">{inner}</div>',
                 f'<div class="post"><div class="entry-content">{inner}</div></div>', f'<div class="article-body">{inner}</div>', f"<section>{inner}</section>",
                 f'<div class="container"><div class="row">{inner}</div></div>', f"<div>{inner}</div>", f'<article class="post"><section>{inner}</section></article>',
                 f"<table><tr><td>{inner}</td></tr></table>", f'<div class="story">{inner}</div>', inner)
    front = [make() for make, chance in ((notice, 0.25), (head, 0.6), (menu, 0.75), (form, 0.2), (advert, 0.4)) if rng.random() < chance]
    back = [make() for make, chance in ((comments, 0.3), (sidebar, 0.4), (advert, 0.2), (form, 0.15), (notice, 0.15), (menu, 0.1)) if rng.random() < chance]
    if rng.random() < 0.3 and back:
        front.append(back.pop())
    end = foot() if rng.random() < 0.8 else ""
    page = "".join(front) + box + "".join(back) + end
    if rng.random() < 0.25:
        page = f'<div class="{rng.choice(["wrapper", "page", "site", "layout", "container"])}">{page}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{page}</body></html>"


_BAD_TAGS = sum(1 << TAGS[t] for t in ("nav", "header", "footer", "aside", "form"))
_BAD_PARTS = sum(1 << (N_TAGS + i) for i in range(1, N_PARTS))


def labelled_nodes(page: Page, by_rule: bool) -> list[float]:
    """1 for nodes that hold main text, 0 for the others, NaN for nodes without text or pages that name no article."""
    held, seen = [0] * len(page.tag), [0] * len(page.tag)
    good = 1 << TAGS["article"]
    path = [0] * len(page.tag)
    for i in range(len(page.tag)):
        path[i] = (path[page.parent[i]] if i else 0) | (1 << page.tag[i]) | (page.parts[i] << N_TAGS)
    for node in page.run_node:
        is_main = page.main[node] if by_rule else bool(path[node] & good) and not path[node] & (_BAD_TAGS | _BAD_PARTS)
        i = node
        while i >= 0:
            seen[i] = 1
            held[i] |= is_main
            i = page.parent[i]
    if not by_rule and not any(held):
        return [math.nan] * len(page.tag)
    return [float(h) if s else math.nan for h, s in zip(held, seen)]


# --- the model -------------------------------------------------------------------------------

@dataclass
class Trees:
    """Boosted trees as arrays: ``nodes[t]`` is (feature, threshold, left, right, value); leaves point to themselves."""

    nodes: list[tuple[np.ndarray, ...]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            total += value[at]
        return total


def _arrays(root, weight: float) -> tuple[np.ndarray, ...]:
    feature, threshold, left, right, value, waiting = [], [], [], [], [], [root]
    while len(feature) < len(waiting):
        node, i = waiting[len(feature)], len(feature)
        inner = node.subtreeDepth() > 0
        value.append(weight * node.prediction())
        feature.append(node.split().featureIndex() if inner else 0)
        threshold.append(node.split().threshold() if inner else math.inf)
        left.append(len(waiting) if inner else i)
        right.append(len(waiting) + 1 if inner else i)
        if inner:
            waiting += [node.leftChild(), node.rightChild()]
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def training_nodes(pages: DataFrame, html: str = "html", rows: int = FIT_PAGES, rule_pages: int = RULE_PAGES) -> DataFrame:
    """``(label, x)`` of the nodes of rule pages and of at most ``rows`` given pages, chosen by a hash of the page."""
    spark = pages.sparkSession

    def of(pages_: list[Page], by_rule: bool) -> pa.RecordBatch:
        x = features(pages_)
        label = np.array([v for p in pages_ for v in labelled_nodes(p, by_rule)])
        keep = ~np.isnan(label)
        x = x[keep].astype(np.float64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(label[keep]), lists], names=["label", "x"])

    def from_rule(batches):
        for batch in batches:
            yield of([Page(rule_page(i)) for i in batch.column(0).to_pylist()], True)

    def from_table(batches):
        for batch in batches:
            yield of([Page(t) for t in batch.column(0).to_pylist()], False)

    n = max(pages.count(), 1)
    draw = F.pmod(F.xxhash64(F.lit(29), F.col(f"`{html}`")), F.lit(1 << 40))
    some = (pages.select(F.col(f"`{html}`").alias("html"), draw.alias("draw")).filter(F.length("html") > 0)
            .filter(F.col("draw") < int(min(1.0, 1.5 * rows / n) * (1 << 40))).orderBy("draw", "html").limit(rows).select("html"))
    schema = "label double, x array<double>"
    return spark.range(0, rule_pages, 1, 4).mapInArrow(from_rule, schema).unionByName(some.mapInArrow(from_table, schema))


def fit(pages: DataFrame, html: str = "html", rows: int = FIT_PAGES, rule_pages: int = RULE_PAGES) -> Trees:
    """Boosted trees fitted by Spark on a bounded table of nodes; only the finished trees reach the driver."""
    nodes = stored(training_nodes(pages, html, rows, rule_pages), "nodes").select("label", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.25, seed=1, minInstancesPerNode=10).fit(nodes)
    return Trees([_arrays(tree._call_java("rootNode"), weight) for tree, weight in zip(model.trees, model.treeWeights)])


def decoded(page: Page, margin: list[float]) -> list[bool]:
    """Which nodes are open: the labelling of the tree of the greatest likelihood in which nothing below a dropped node is open.

    A node without text below it is neutral. Equal likelihoods drop.
    """
    n = len(page.tag)
    seen, keep, drop = [False] * n, [0.0] * n, [0.0] * n
    for node in page.run_node:
        seen[node] = True
    for i in range(n - 1, 0, -1):
        if seen[i]:
            z = max(-30.0, min(30.0, 2.0 * margin[i]))
            keep[i] -= math.log1p(math.exp(-z))
            drop[i] -= math.log1p(math.exp(z))
            up = page.parent[i]
            seen[up] = True
            keep[up] += max(keep[i], drop[i])
            drop[up] += drop[i]
    open_ = [True] * n
    for i in range(1, n):
        open_[i] = open_[page.parent[i]] and keep[i] > drop[i]
    return open_


def extracted(pages: list[Page], trees: Trees) -> list[str]:
    if not pages:
        return []
    margin = trees.margin(features(pages)).tolist()
    out, low = [], 0
    for page in pages:
        open_ = decoded(page, margin[low: low + len(page.tag)])
        out.append("\n".join(t for node, t in zip(page.run_node, page.run_text) if open_[node]))
        low += len(page.tag)
    return out


def extract(pages: DataFrame, trees: Trees, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` and ``text``: the blocks of main text, white space as one space, joined by line feeds.

    Every page is parsed whole. NULL and empty pages, and pages without main text, give an empty text; text outside any
    element counts as the page's own block. Repeated rows get the same answer; an own column ``text`` is replaced.
    """
    keep = [c for c in keep if c != "text"]
    table = pages.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, html])])
    schema = ", ".join([*(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts: list[str] = []
            for low in range(0, batch.num_rows, 128):
                texts += extracted([Page(t or "") for t in column[html].slice(low, 128).to_pylist()], trees)
            yield pa.RecordBatch.from_arrays([*(column[c] for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return table.mapInArrow(run, schema)
