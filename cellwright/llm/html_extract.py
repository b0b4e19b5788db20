"""Main text of HTML pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A block element is described by its tag and attribute tokens, the density of its subtree, its
depth and place, and its siblings. Boosted trees give the log-odds that its text belongs to the
article. Decoding keeps the subtree, grown from the root, with the largest sum of log-odds
weighted by text: a block that goes takes its descendants along, and one that stays may still
lose some. No block is kept below one that is not.

There are no labelled pages, so the trees learn from two sources: made-up pages in four manners
(semantic elements, named divisions, divisions with meaningless names, tables), whose labels are
known, and a bounded sample of the corpus, at most ``NODES`` blocks of each of the ``SAMPLE`` pages
with the smallest hash of their id, labelled where elements or attributes say themselves what they
are. Tags and attributes of a part of the training pages are made neutral, so the trees also learn
to go by text, density and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .html_tree import KINDS, N_FEATURES, Block, features, parse

SAMPLE = 300
NODES = 256
MADE_UP = 500
SEED = 5

_SHUNNED = {"nav", "aside", "header", "footer", "form", "menu", "dialog", "search"}
#: Letters of made-up words: consonants and vowels of three scripts.
_LETTERS = (("bcdfgklmnprstvw", "aeiouy"), ("бвгдзклмнпрст", "аеиоуы"), ("βγδκλμνπρστ", "αειου"))


class _Writer:
    """Random text and markup of one made-up page."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.script = _LETTERS[0 if rng.random() < 0.8 else int(rng.integers(1, len(_LETTERS)))]

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def often(self, share: float) -> bool:
        return self.rng.random() < share

    def word(self) -> str:
        c, v = self.script
        return "".join(self.pick(*c) + self.pick(*v) for _ in range(int(self.rng.integers(1, 5))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(low, high + 1))))

    def prose(self, low: int, high: int) -> str:
        """Sentences, here and there with a link or emphasis."""
        out = []
        for _ in range(int(self.rng.integers(low, high + 1))):
            text = self.words(1, 20)
            if self.often(0.1):
                tag = self.pick("a href=#", "em", "strong", "code", "b", "i")
                text += f" <{tag}>{self.words(1, 3)}</{tag.split()[0]}> " + self.words(0, 6)
            out.append(text.capitalize() + self.pick(".", ".", ".", "?", "!"))
        return " ".join(out)

    def links(self, low: int, high: int, item: str = "li") -> str:
        return "".join(f"<{item}><a href='/{i}'>{self.words(1, 4)}</a></{item}>" for i in range(int(self.rng.integers(low, high + 1))))

    def box(self, tag: str, names: tuple[str, ...], inner: str, manner: str) -> str:
        """``inner`` in an element as the manner of the page has it."""
        key = self.pick("class", "class", "id")
        if manner == "semantic":
            return f"<{tag}>{inner}</{tag}>"
        if manner == "named":
            return f'<div {key}="{self.pick(*names)}">{inner}</div>'
        if manner == "table":
            return f'<table {key}="{self.pick(*names)}"><tr><td>{inner}</td></tr></table>' if self.often(0.3) else f"<table><tr><td>{inner}</td></tr></table>"
        return f'<div class="x{int(self.rng.integers(1 << 20)):x}">{inner}</div>'


def _around(w: _Writer, manner: str) -> list:
    """Makers of what stands around an article."""
    return [
        lambda: w.box("nav", ("menu", "nav-bar", "siteNavigation", "breadcrumb"), f"<ul>{w.links(2, 9)}</ul>", manner),
        lambda: w.box("header", ("masthead", "page-header", "topbar"), f"<h1>{w.words(1, 3)}</h1><p>{w.words(2, 8)}</p>{w.links(0, 5, 'span')}", manner),
        lambda: f'<div class="{w.pick("ad", "ads", "advert-slot", "sponsored", "promo")}">{w.prose(1, 3)}</div>',
        lambda: w.box("aside", ("sidebar", "rail", "widget-area", "related"), f"<h3>{w.words(1, 3)}</h3><p>{w.prose(1, 3)}</p><ul>{w.links(0, 6)}</ul>", manner),
        lambda: f'<div {w.pick("class", "id")}="{w.pick("cookie-bar", "notice", "alert", "gdpr-consent", "newsletter", "modal")}"><p>{w.prose(1, 3)}</p><button>{w.words(1, 2)}</button></div>',
        lambda: f"<form><label>{w.words(1, 3)}</label><input name=q><p>{w.words(1, 9)}</p><button>{w.words(1, 2)}</button></form>",
    ]


def _below(w: _Writer, manner: str) -> list:
    """Makers of what stands below one: footers and readers' comments."""
    return [
        lambda: w.box("footer", ("footer", "site-footer", "bottom", "copyright"), w.pick("<p>&copy; {}</p><ul>{}</ul>", "&copy; {}{}", "<p>{}</p><p>{}</p>").format(w.prose(1, 3), w.links(0, 5, "span")), manner),
        lambda: f'<{(tag := w.pick("section", "div"))} {w.pick("id", "class")}="{w.pick("comments", "discussion", "replies", "commentList")}"><h2>{w.words(1, 2)}</h2>' + "".join(f'<{(one := w.pick("div", "article", "li"))} class="{w.pick("comment", "reply")}"><p>{w.prose(1, 4)}</p></{one}>' for _ in range(int(w.rng.integers(1, 6)))) + f"</{tag}>",
    ]


def _article(w: _Writer, around: list) -> str:
    """Blocks of an article, marked data-main, and what some sites put between them."""
    out = [f"<h1 data-main>{w.words(1, 10)}</h1>"] if w.often(0.8) else []
    for _ in range(int(w.rng.integers(1, 16))):
        text = w.prose(1, 9) if w.often(0.85) else w.words(1, 3)
        out.append(w.pick(*[
            lambda: f"<p data-main>{text}" + w.pick("</p>", "</p>", "</p>", ""),
            lambda: f"<p data-main>{text}" + w.pick("</p>", "</p>", "<br>"),
            lambda: f"<p data-main>{text}</p>",
            lambda: f"<p data-main>{text}</p>",
            lambda: f"<p data-main>{text}</p><h2 data-main>{w.words(1, 6)}</h2><p data-main>{w.prose(1, 6)}</p>",
            lambda: f"<p data-main>{text}</p>" + w.pick("<ul>", "<ol>") + "".join(f"<li data-main>{w.words(2, 14)}" for _ in range(int(w.rng.integers(2, 6)))) + "</ul>",
            lambda: f"<blockquote data-main>{text}</blockquote>",
            lambda: "<table>" + "".join(f"<tr><td data-main>{w.words(1, 4)}<td data-main>{w.words(1, 4)}" for _ in range(int(w.rng.integers(1, 5)))) + "</table>",
            lambda: f"<div data-main>{text}</div>",
            lambda: f"<dl><dt data-main>{w.words(1, 3)}<dd data-main>{w.prose(1, 2)}</dl>",
            lambda: f"<pre data-main>{w.words(4, 30)}</pre>",
            lambda: f"<figure><img src=i><figcaption data-main>{w.words(3, 12)}</figcaption></figure>",
            lambda: w.pick(*around)(),
            lambda: around[2](),
        ])())
    return "".join(out)


def made_up_page(rng: np.random.Generator) -> str:
    """A page; parts of the article carry data-main, all else doesn't."""
    w = _Writer(rng)
    manner = w.pick("semantic", "semantic", "named", "nameless", "table")
    around, below = _around(w, manner), _below(w, manner)
    some = lambda makers, most: "".join(w.pick(*makers)() for _ in range(int(rng.integers(0, most + 1))))
    tag = w.pick("article", "article", "main", "section") if manner == "semantic" else w.pick("div", "div", "td", "section") if manner == "table" else "div"
    named = f' {w.pick("class", "id")}="{w.pick("article-body", "post", "entry-content", "content", "story", "main-text")}"' if manner == "named" and w.often(0.8) else ""
    body = f"<{tag}{named}>{_article(w, around)}</{tag}>"
    if tag == "td":
        body = f"<table><tr><td>{some(around, 2)}</td>{body}<td>{some(around, 2)}</td></tr></table>"
    if w.often(0.4):
        outer = w.pick("main" if manner == "semantic" else "div", "div", 'div id="wrapper"', 'div class="container"')
        body = f"<{outer}>{some(around, 1)}{body}{some(around + below, 2)}</{outer.split()[0]}>"
    page = f"{some(around, 4)}{body}{some(around[2:] + below, 3)}{below[0]() if w.often(0.6) else ''}"
    return f"<!DOCTYPE html><html><head><title>{w.words(1, 5)}</title></head><body>{page}</body></html>"


def _examples(page: str, known: bool) -> tuple[list[list[float]], list[float], list[float]]:
    """Features, labels and weights of a page's blocks; none if nothing tells what they are."""
    blocks, _ = parse(page)
    marked = [b.main for b in blocks] if known else _self_told(blocks)
    if marked is None:
        return [], [], []
    share, text = [0.0] * len(blocks), [0.0] * len(blocks)
    for i in range(len(blocks) - 1, -1, -1):
        text[i] += blocks[i].own
        share[i] += blocks[i].own * marked[i]
        if i:
            text[blocks[i].up] += text[i]
            share[blocks[i].up] += share[i]
    keep = [i for i in range(len(blocks)) if text[i]]
    x = features(blocks)
    return [x[i] for i in keep], [float(share[i] > text[i] / 2) for i in keep], [1.0 + (blocks[i].own > 0) for i in keep]


def _self_told(blocks: list[Block]) -> list[bool] | None:
    """Labels of a page whose elements name the article: inside it, and in nothing that is shunned."""
    inside, out = [False] * len(blocks), [False] * len(blocks)
    for i, b in enumerate(blocks):
        shunned = b.tag in _SHUNNED or b.bad > 0
        inside[i] = (i > 0 and inside[b.up] or b.tag in ("article", "main")) and not shunned
        out[i] = inside[i]
    return out if any(inside) else None


def _neutral(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    x = x.copy()
    hide_attrs = rng.random(len(x)) < 0.5
    x[np.ix_(hide_attrs, [len(KINDS) + 1, len(KINDS) + 3])] = 0
    kinds = [i for i, k in enumerate(KINDS) if k[0] in ("article", "main", "section")]
    div = next(i for i, k in enumerate(KINDS) if k[0] == "div")
    swap = (rng.random(len(x)) < 0.5) & (x[:, kinds].sum(axis=1) > 0)
    x[np.ix_(swap, kinds)] = 0
    x[swap, div] = 1
    return x


def train(pages: DataFrame, sample: int = SAMPLE, made_up: int = MADE_UP, nodes: int = NODES) -> boosting.Boosted:
    """Trees from made-up pages and at most ``nodes`` blocks of ``sample`` pages of the corpus.

    Pages are parsed where they are; the driver gets the features of that many blocks.
    """
    # The ids of the sample first, so that no task sends pages that others outdo.
    some = pages.filter(F.col("html").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), "html")
    ids = some.select("page_id").orderBy(F.xxhash64("page_id", F.lit(SEED)), "page_id").limit(sample).distinct()
    chosen = some.join(F.broadcast(ids), "page_id")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page_id, page in zip(b.column("page_id"), b.column("html")):
                x, y, w = (np.array(v, float) for v in _examples(page.as_py(), False))
                if len(y):
                    at = np.unique(np.linspace(0, len(y) - 1, nodes).astype(int))  # spread over the page
                    kept = [x[at].tobytes(), y[at].tobytes(), w[at].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([page_id.as_py()], pa.int64()), *(pa.array([k], pa.binary()) for k in kept)], names=["page_id", "x", "y", "w"])

    rows = chosen.mapInArrow(told, "page_id long, x binary, y binary, w binary").orderBy(F.xxhash64("page_id", F.lit(SEED)), "page_id", "x").limit(sample).collect()
    rng = np.random.default_rng(SEED)
    x, y, w = [], [], []
    for _ in range(made_up):
        for total, part in zip((x, y, w), _examples(made_up_page(rng), True)):
            total.append(np.array(part, float))
    for r in rows:
        for total, part, shape in zip((x, y, w), (r["x"], r["y"], r["w"]), ((-1, N_FEATURES), -1, -1)):
            total.append(np.frombuffer(part).reshape(shape))
    x, y, w = np.vstack([p for p in x if len(p)]), np.concatenate(y), np.concatenate(w)
    return boosting.fit(np.vstack([x, _neutral(x, rng)]), np.concatenate([y, y]), np.concatenate([w, w]))


def decode(blocks: list[Block], log_odds: np.ndarray) -> list[bool]:
    """The rooted subtree with the largest sum of log-odds times text; ties keep less."""
    n = len(blocks)
    gain = [float(o) * (1.0 + b.own) for o, b in zip(log_odds, blocks)]
    gain[0] = 0.0
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[blocks[i].up] += gain[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[blocks[i].up] and gain[i] > 0
    return keep


def _texts(pages: list[str], model: boosting.Boosted) -> list[str]:
    parsed = [parse(p) for p in pages]
    rows = [features(blocks) for blocks, _ in parsed]
    odds = model.log_odds(np.array([r for page in rows for r in page])) if rows else np.zeros(0)
    out, at = [], 0
    for blocks, runs in parsed:
        keep = decode(blocks, odds[at : at + len(blocks)])
        at += len(blocks)
        out.append("\n\n".join(text for b, text in runs if keep[b]))
    return out


#: Pages whose nodes are scored together.
TOGETHER = 64


def extract(pages: DataFrame, model: boosting.Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) for every row.

    A null html is an empty page, and its text is empty, as is that of a page without an article.
    Null ids and urls are passed through, rows that repeat are extracted each, an empty table
    gives no rows; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages))  # some tens of kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, TOGETHER) for i in range(0, big.num_rows, TOGETHER)):
                texts = _texts([h or "" for h in b.column("html").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
