"""Small per-text helpers over public tokenizer files: pre-tokens, and a streaming byte-level BPE.

The files' path is a parameter of every operator; ``default_path`` only finds the installed ones.

``Stream`` takes a text in chunks and gives ids once they are final; within a pre-token, ``Transducer``
and ``Run`` encode a byte stream with bounded lookahead. Compare BPE on a stream with BPE on
a prefix of it: both do the same left of a frontier, which starts at the prefix's end. A merge
rule (u, v) moves the frontier left by len(u) if u stands left of it and v begins at it in one of
the two runs only, so v grew to the right from the left part u' of the rule (u', v') that moved
the frontier last; u' lies on v's left spine and (u', v') has a lower rank. Each rule moves it
once at most. The heaviest such chain of rules bounds how far the frontier gets:

    reach(u, v) = len(u) + max(reach of earlier rules whose left part is on v's left spine, or 0)

A token that ends ``lookahead`` = max reach bytes before what has been read is therefore final.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import regex

# The pre-token patterns of the two vocabularies.
WORDPIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTEPIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these characters Unicode versions may differ, and the library itself splits the text.
UNUSUAL = re.compile("[^\t-\r -ɏ‐-‧]")
_ASCII = {WORDPIECE: re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+"), BYTEPIECE: re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")}
_LATIN = {p: regex.compile(p.replace(r"[^\s", r"[^\t-\r\x20\x85\xa0").replace(r"\s", r"[\t-\r\x20\x85\xa0]").replace(r"(?!\S)", r"(?![^\t-\r\x20\x85\xa0])")) for p in (WORDPIECE, BYTEPIECE)}
#: Texts are split in pieces of about so many characters, at a word's end before white space.
PIECE = 1 << 16
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")
#: Results of pre-tokens up to this many bytes are remembered, and so many of them at most.
SHORT, REMEMBERED = 48, 1 << 19
#: Bytes up to which a list of ranks is searched instead of a heap.
LISTED = 96


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces; no pre-token spans two of them."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@lru_cache(4)
def _byte_chars() -> tuple[list[str], dict[str, int]]:
    """The printable character of each byte in byte-level vocabularies, and back."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)], {c: b for b, c in chars.items()}


class Vocabulary:
    """A tokenizers file: its special strings and its pre-tokens, as the library splits them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spec = json.load(open(path, encoding="utf-8"))  # a file of the installed package
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.lower = self.spec["normalizer"] is not None
        self.pattern = WORDPIECE if self.lower else BYTEPIECE
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def sections(self, text: str, empty: bool = False) -> Iterator[tuple[str, bool]]:
        """(part, whether it is a special string), which the library takes out first; empty parts if asked for."""
        for i, part in enumerate(self._special.split(text)):
            if part or empty:
                yield part, bool(i % 2)

    def pretokens(self, part: str) -> list[str]:
        if part.isascii() and not UNUSUAL.search(part):
            return _ASCII[self.pattern].findall(part.lower() if self.lower else part)
        if not UNUSUAL.search(part):
            if self.lower:
                part = unicodedata.normalize("NFC", part).lower()
            return _LATIN[self.pattern].findall(part)
        if self.lower:
            part = self.library.normalizer.normalize_str(part)
        back = _byte_chars()[1]
        return [bytes(map(back.__getitem__, t)).decode("utf-8", "surrogatepass") for t, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]

    def count(self, pretoken: str) -> int:
        """Pieces of one pre-token."""
        chars = _byte_chars()[0]
        return len(self.library.model.tokenize("".join(map(chars.__getitem__, pretoken.encode("utf-8")))))


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """Byte-level BPE over a stream: ``encode`` yields ids as soon as they are final."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        back = _byte_chars()[1]
        raw = lambda t: bytes(map(back.__getitem__, t))
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in back for c in t)}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges)
        # The same merges by ids: a pair as one number, and what it becomes by rank.
        self._byte = [self.ids[bytes([b])] for b in range(256)]
        self._pair = {self.ids[u] << 20 | self.ids[v]: r for r, (u, v) in enumerate(merges)}
        self._merged = [self.ids[u + v] for u, v in merges]
        self._known: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """BPE of bytes that are all there: lowest rank first, leftmost first."""
        rank, n = self.rank, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or rank.get((part[i], part[j])) != r:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in part if p is not None]

    def _listed(self, data: bytes) -> list[int]:
        """Ids of few bytes: a plain list of ranks, whose minimum is quicker to find than a heap is kept."""
        get, none, merged = self._pair.get, len(self._merged), self._merged
        part = list(map(self._byte.__getitem__, data))
        ranks = [get(a << 20 | b, none) for a, b in zip(part, part[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            part[i] = merged[least]
            del part[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(part[i - 1] << 20 | part[i], none)
            if i < len(ranks):
                ranks[i] = get(part[i] << 20 | part[i + 1], none)
        return part

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that comes in chunks; holds a chunk and the lookahead at most."""
        run = Run(self)
        for chunk in chunks:
            yield from run.push(chunk)
        yield from run.end()

    def pretoken(self, pretoken: str, chunk: int = 1 << 12) -> tuple[int, ...] | list[int]:
        """Ids of a pre-token; those of a short one are remembered."""
        found = self._known.get(pretoken)
        if found is None:
            data, run = pretoken.encode("utf-8", "surrogatepass"), Run(self)
            found = tuple(chain.from_iterable([*(run.push(data[i : i + chunk]) for i in range(0, len(data), chunk)), run.end()]))
            if len(data) <= SHORT:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                self._known[pretoken] = found
        return found

    def pretokens(self, split: list[str]) -> list[int]:
        found = list(map(self._known.get, split))
        if None in found:
            found = [x if x is not None else self.pretoken(t) for x, t in zip(found, split)]
        return list(chain.from_iterable(found))

    def encode(self, text: str, words: Vocabulary, chunk: int = PIECE) -> Iterator[list[int]]:
        """Ids of a text that is read in chunks, each as soon as it is final."""
        state = Stream(self, words)
        for at in range(0, len(text), chunk):
            if at + chunk < len(text):
                yield state.push(text[at : at + chunk])
            else:
                yield state.end(text[at:])

    def decode(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """Text of ids, a piece at a time: bytes of a character that is not whole yet are held."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        of = self.bytes_of.__getitem__
        for piece in ids:
            yield state.decode(b"".join(map(of, piece)))
        yield state.decode(b"", True)


class Run:
    """One pre-token on its way through the transducer: bytes in, ids out once they are final."""

    def __init__(self, coder: Transducer):
        self.coder, self.held = coder, b""

    def push(self, data: bytes) -> list[int]:
        self.held += data
        sure, done, out = len(self.held) - self.coder.lookahead, 0, []
        for token in self.coder.merge(self.held) if sure > 0 else ():
            if done + len(token) > sure:
                break
            out.append(self.coder.ids[token])
            done += len(token)
        self.held = self.held[done:]
        return out

    def end(self) -> list[int]:
        held, self.held = self.held, b""
        return self.coder._listed(held) if len(held) <= LISTED else [self.coder.ids[t] for t in self.coder.merge(held)]


class Stream:
    """A text on its way through: characters in, ids out once they are final.

    The end of a pre-token settles its ids. Where one ends is settled by three characters after it
    at most, so all but the last three pre-tokens of what has been read are final. A pre-token that
    doesn't end for ``LONG`` characters goes through a ``Run`` as it comes; what belongs to it is
    found by splitting two of its characters together with those that follow. Special strings come
    first: as many characters are held back as might be the beginning of one.
    """

    LONG = 1 << 12

    def __init__(self, coder: Transducer, words: Vocabulary):
        self.coder, self.words = coder, words
        self.tail, self.seed, self.run = "", "", None
        self.keep = max([1, *map(len, words.special)])

    def push(self, text: str) -> list[int]:
        *whole, last = self.words.sections(self.tail + text, True)
        out = [i for part, special in whole for i in (self._all(part) if not special else [self.words.special[part]])]
        return out + self._some(last[0])

    def end(self, text: str = "") -> list[int]:
        out: list[int] = []
        for part, special in self.words.sections(self.tail + text):
            out += [self.words.special[part]] if special else self._all(part)
        out += self._all("")
        self.tail = ""
        return out

    def _continued(self, text: str) -> tuple[list[int], str]:
        """Ids that the open run gives for what is its own of a text, and the rest, with the run ended if there is one."""
        split = self.words.pretokens(self.seed + text) if text else [self.seed]
        own = len(split[0]) - len(self.seed)
        out = self.run.push(text[:own].encode("utf-8", "surrogatepass"))
        return out, text[own:]

    def _all(self, text: str) -> list[int]:
        """A section's end."""
        out: list[int] = []
        if self.run:
            out, text = self._continued(text)
            out += self.run.end()
            self.run = None
        return out + self.coder.pretokens(self.words.pretokens(text)) if text else out

    def _some(self, text: str) -> list[int]:
        out: list[int] = []
        if self.run:
            split = self.words.pretokens(self.seed + text)
            if len(split) == 1:  # it goes on
                sure = text[: -self.keep]
                self.tail = text[len(sure) :]
                self.seed = (self.seed + sure)[-2:]
                return self.run.push(sure.encode("utf-8", "surrogatepass"))
            if sum(map(len, split[1:])) <= self.keep:  # its end isn't settled
                self.tail = text
                return out
            out, text = self._continued(text)
            out += self.run.end()
            self.run = None
        split = self.words.pretokens(text)
        out += self.coder.pretokens(split[:-3])
        split = split[-3:]
        if split and len(split[-1]) > self.LONG + self.keep:
            out += self.coder.pretokens(split[:-1])
            sure, self.tail = split[-1][: -self.keep], split[-1][-self.keep :]
            self.run, self.seed = Run(self.coder), sure[-2:]
            return out + self.run.push(sure.encode("utf-8", "surrogatepass"))
        self.tail = "".join(split)
        return out


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that settle it, from the merge list (see the module's text)."""
    left: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    for u, v in merges:
        furthest, x = 0, v
        while x is not None:
            furthest = max(furthest, reach.get(x, 0))
            x = left.get(x)
        left.setdefault(u + v, u)
        reach[u] = max(reach.get(u, 0), len(u) + furthest)
    return max(reach.values(), default=0)


@lru_cache(4)
def transducer(path: str) -> Transducer:
    return Transducer(path)
