"""Block elements of an HTML page, their text and their features: a small per-page helper.

Real pages are not well formed, so this does what matters for text: raw elements end at their own
end tag, a block ends an open paragraph, an end tag closes what it can, and whatever is open at
the end is closed. Inline elements belong to the block around them. Tags are read as browsers do:
a quote counts at the start of an attribute's value only. A page with a tag that never ends is
read on with every tag ending at the next ``>``. All steps look at each character and each open
element a constant number of times.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

# Elements that make a block of their own, that hold no text of the page, and that have no end.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style title textarea noscript template iframe object svg annotation annotation-xml canvas audio video select option datalist head xmp noembed noframes".split())
RAW = frozenset("script style title textarea iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An end tag of these may be missing: the next one of the same list, or a block, ends them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

# Tokens of class, id and role that tell what a block is for.
GOOD = frozenset("article content post entry story main body text prose page read reader paragraph document blogpost hentry articlebody maincontent".split())
BAD = frozenset("nav navbar navigation menu header head masthead topbar footer foot bottom sidebar side aside rail widget widgets ad ads advert adverts advertisement banner promo promotion promoted sponsor sponsored cookie cookies consent gdpr notice notices alert warning popup modal overlay subscribe subscription newsletter signup comment comments reply replies respond discussion disqus share sharing social follow related recommended recommendations more breadcrumb breadcrumbs pagination pager login search form copyright legal toolbar tools meta tags toc skip hidden print author byline rating vote".split())

_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*+")
_KEY = re.compile(r"[ \t\n\f\r/]*+([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)?+[ \t\n\f\r]*+(=[ \t\n\f\r]*+)?+")
_PLAIN = re.compile(r"[^ \t\n\f\r>]*+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"\s+")
_ENDS = re.compile(r"[.!?;:,]")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I) for tag in RAW}


class Block:
    __slots__ = ("tag", "up", "depth", "good", "bad", "own", "link", "marks", "tags", "kids", "start", "turn", "main")

    def __init__(self, tag: str, up: int, depth: int, good: int, bad: int, start: int, main: bool = False):
        self.tag, self.up, self.depth, self.good, self.bad, self.start, self.main = tag, up, depth, good, bad, start, main
        self.own = self.link = self.marks = self.tags = self.kids = self.turn = 0


def _lexicon(attrs: dict[str, str]) -> tuple[int, int]:
    good = bad = 0
    for name in ("class", "id", "role"):
        for p in _PART.findall(attrs.get(name, "")):
            p = p.lower()
            good += p in GOOD
            bad += p in BAD
    return good, bad


def read_tag(page: str, at: int) -> tuple[dict[str, str], int] | None:
    """Attributes of a tag from behind its name, and where it ends; None if it doesn't.

    Of two attributes of a name the first counts. ``/`` among the attributes is kept as one if
    the tag ends with it.
    """
    attrs: dict[str, str] = {}
    while True:
        m = _KEY.match(page, at)
        at = m.end()
        if at >= len(page):
            return None
        if m[1] is None:
            if page[at - 1] == "/":
                attrs["/"] = ""
            return attrs, at + 1  # at a >
        value = ""
        if m[2]:
            if (quote := page[at]) in "\"'":
                end = page.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            else:
                value, at = page[at : (end := _PLAIN.match(page, at).end())], end
        attrs.setdefault(m[1].lower(), value)


def tokens(page: str):
    """(text, tag, attributes, is an end) in order, each with a text or a tag."""
    at = said = 0  # text from ``said`` on is still to be given
    whole = True
    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        closing = after == "/"
        name = _NAME.match(page, start + 1 + closing)
        if name is None and after not in ("!", "?", "/"):
            at = start + 1  # a bare <
            continue
        if name is None:
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + 2)
            end = len(page) if end < 0 else end + len(mark)
            yield page[said:start], None, None, False
            at = said = end
            continue
        found = read_tag(page, name.end()) if whole else None
        if found is None:
            whole = False
            if (end := page.find(">", name.end())) < 0:
                break  # the rest is text
            found = {}, end + 1
        yield page[said:start], None, None, False
        tag, (attrs, at) = name[0].lower(), found
        said = at
        yield "", tag, attrs, closing
        if tag in RAW and not closing and "/" not in attrs:
            if (end := _RAW_END[tag].search(page, at)) is None or (stop := page.find(">", end.end())) < 0:
                return
            at = said = stop + 1
    yield page[said:], None, None, False


def parse(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """The blocks, the root first, and (block, text) for every run of text between block edges."""
    blocks = [Block("html", -1, 0, 0, 0, 0)]
    runs: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, with the block around or of them
    places: dict[str, list[int]] = defaultdict(list)  # of each tag in the stack
    walls = [0]  # places of the open blocks
    in_link = hidden = 0
    seen = 0
    last = lambda tags: max((places[t][-1] for t in tags if places[t]), default=-1)

    def say(text: str) -> None:
        nonlocal seen
        if hidden or not text:
            return
        text = html.unescape(text)
        parts.append(text)
        n = len(text) - text.count(" ") - text.count("\n")
        b = blocks[stack[-1][1]]
        b.own += n
        b.marks += len(_ENDS.findall(text))
        seen += n
        if in_link:
            b.link += n

    def edge() -> None:
        if parts:
            text = _WHITE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                runs.append((stack[-1][1], text))

    def shut(index: int) -> None:
        """Close the open elements from ``index`` on."""
        nonlocal in_link, hidden
        if walls[-1] >= index:
            edge()
        for t, _ in stack[index:]:
            in_link -= t == "a"
            hidden -= t in HIDDEN
            places[t].pop()
        del stack[index:]
        while walls[-1] >= index:
            walls.pop()

    for text, tag, attrs, closing in tokens(page):
        if tag is None:
            say(text)
            continue
        if closing:
            at = last((tag,))
            # An inline end tag doesn't close blocks, unless what it ends shows nothing.
            if at >= 0 and (tag in BLOCKS or tag in HIDDEN or at > walls[-1]):
                shut(at)
            continue
        if tag in BLOCKS or tag == "body":
            if (at := last(("svg",))) > walls[-1]:
                shut(at)  # a drawing holds no blocks
            if stack[walls[-1]][0] == "p":
                shut(walls[-1])
        if tag in CLOSES:
            wall = last(_BARRIER.get(tag, ()))
            if open_ := [at for t in CLOSES[tag] if places[t] and (at := places[t][-1]) > wall]:
                shut(min(open_))
        blocks[stack[-1][1]].tags += 1
        if tag == "br":
            if not hidden:
                parts.append(" ")
            continue
        if tag in BLOCKS:
            edge()
            if tag in ("html", "hr"):
                continue
            up = stack[-1][1]
            good, bad = _lexicon(attrs)
            parent = blocks[up]
            blocks.append(Block(tag, up, parent.depth + 1, good, bad, seen, "data-main" in attrs))
            blocks[-1].turn, parent.kids = parent.kids, parent.kids + 1
            walls.append(len(stack))
            places[tag].append(len(stack))
            stack.append((tag, len(blocks) - 1))
        elif tag not in VOID and tag not in RAW and "/" not in attrs:
            places[tag].append(len(stack))
            stack.append((tag, stack[-1][1]))
            in_link += tag == "a"
            hidden += tag in HIDDEN
    edge()
    return blocks, runs


# Groups of elements that the features tell apart.
KINDS = (("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("li", "dd", "dt"), ("ul", "ol", "dl", "menu", "dir"), ("div", "center"), ("section",), ("article",), ("main",), ("nav", "search"), ("aside",), ("header",), ("footer", "address"), ("form", "fieldset", "dialog"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("figure", "figcaption", "details", "summary"))
_KIND = {t: i for i, ts in enumerate(KINDS) for t in ts}
_SHUNNED = {"nav", "aside", "header", "footer", "form", "menu", "dialog", "search"}
N_FEATURES = len(KINDS) + 19


def features(blocks: list[Block]) -> list[list[float]]:
    """A row a block: what it is, its attributes, its subtree's density, its place, its siblings."""
    n = len(blocks)
    chars, link, marks, tags, inner = ([getattr(b, k) for b in blocks] for k in ("own", "link", "marks", "tags", "kids"))
    for i in range(n - 1, 0, -1):
        up = blocks[i].up
        for total in (chars, link, marks, tags, inner):
            total[up] += total[i]
    total = max(1, chars[0])
    same: dict[tuple[int, str], int] = {}
    for b in blocks[1:]:
        same[b.up, b.tag] = same.get((b.up, b.tag), 0) + 1
    rows, good_above, bad_above = [], [0.0] * n, [0.0] * n
    for i, b in enumerate(blocks):
        p = blocks[b.up] if i else b
        if i:
            good_above[i] = good_above[b.up] + (p.good > 0 or p.tag in ("article", "main"))
            bad_above[i] = bad_above[b.up] + (p.bad > 0 or p.tag in _SHUNNED)
        kinds = [0.0] * len(KINDS)
        if b.tag in _KIND:
            kinds[_KIND[b.tag]] = 1.0
        kids, c = max(1, p.kids), max(1, chars[i])
        rows.append([
            *kinds, b.depth, b.good, b.bad, good_above[i], bad_above[i], math.log1p(chars[i]), math.log1p(b.own), link[i] / c, marks[i] / c,
            c / (1 + tags[i]), tags[i], inner[i], chars[i] / total, b.start / total, b.turn / kids, math.log1p(kids),
            same.get((b.up, b.tag), 1) / kids, chars[i] * kids / max(1, chars[b.up] if i else chars[0]), link[b.up] / max(1, chars[b.up]) if i else 0.0,
        ])
    return rows
