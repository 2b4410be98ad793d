"""Main text of web pages by a recurrent labeller of their text blocks.

A page is cut into the sequence of its leaf blocks: text between block-level tags.  Each block has a vector of its
hashed tag path (tags, classes, ids and roles of its open elements), of its hashed words, and of a few sizes.  A
bidirectional LSTM, in NumPy, reads the whole sequence, however long, and labels every block as main text or not.

The model is trained here, on a bounded sample of the pages themselves.  A sampled block's label comes from the meaning
of the elements it stands in, where they have one; else from its own figures: blocks that other sampled pages repeat,
and blocks that are mostly links, are boilerplate, and sentences of some length are main text, as is what shares
their container.  Each sampled page is also rearranged: its article in other containers, often of names without
meaning, among boilerplate of other kinds, so that the network must read more than names.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Expected number of sampled pages, and rearranged copies of each in training.
SAMPLE_PAGES, COPIES = 120, 10
PATH_DIMS, WORD_DIMS, SIZE_DIMS, HIDDEN = 512, 32, 6, 16
EPOCHS, RATE, BATCH = 14, 0.02, 96
#: Blocks whose vectors are in memory at a time; both directions carry their states over the runs of longer pages.
RUN = 2048

# Elements that stand inside a line, elements without end tag, and elements whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("noscript template svg math object select option optgroup datalist".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
# Elements and name parts that say what they hold.
MAIN_TAGS = frozenset("article main".split())
SIDE_TAGS = frozenset("nav header footer aside form button menu dialog".split())
SIDE_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion footer header login menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion related reply responses search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
MAIN_NAMES = frozenset("article articlebody content entry main post story".split())
#: Of blocks in elements without meaning: least words of a sentence that is main text, share of links that is none.
SENTENCE_WORDS, LINK_SHARE = 12, 0.5

# A quote that no quote closes before a space, / or > is no quote; such a tag ends at its first >.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?[A-Za-z][^\s/>]*(?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*>|</?[A-Za-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")


#: Ends of sentences, and the scripts that put no spaces between words: two characters of those count as a word.
_ENDS = ".!?…。！？"
_UNSPACED = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def name_parts(value: str) -> list[str]:
    """Names in a class, id, role or itemprop: one or two parts of each, of longer ones the last, which says what the others qualify."""
    out = []
    for token in value.lower().split():
        parts = _PARTS.findall(token)
        out += [f".{x}" for x in (parts if len(parts) <= 2 else parts[-1:])]
    return out


def word_count(text: str) -> int:
    return max(text.count(" ") + 1, 0 if text.isascii() else len(_UNSPACED.findall(text)) // 2)


class Path(NamedTuple):
    """The open elements of a block, of fixed size however many they are."""

    bits: int
    depth: int
    leaf: str
    main: bool
    side: bool
    silent: bool
    parent: int

    def below(self, names: tuple[str, ...]) -> Path:
        """The path of an element in this one: its tag, and its name parts after a dot.

        The header of an article is the article's; any other header is boilerplate.
        """
        tag = names[0]
        bits = self.bits
        for x in names:
            bits |= 1 << zlib.crc32(x.encode()) % PATH_DIMS
        main = self.main or any(x in MAIN_TAGS or (x[0] == "." and x[1:] in MAIN_NAMES) for x in names)
        side = self.side or any(x in SIDE_TAGS or (x[0] == "." and x[1:] in SIDE_NAMES) for x in names if not (self.main and x == "header"))
        return Path(bits, self.depth + 1, tag, main, side, self.silent or tag in SILENT, self.bits)


TOP = Path(0, 0, "", False, False, False, 0)
Block = tuple[str, Path, int]


def path_of(*names: str) -> Path:
    """The path of nested elements; a name part belongs to the element before it."""
    path, own = TOP, []
    for x in [*names, "end"]:
        if x[0] != "." and own:
            path, own = path.below(tuple(own)), []
        own.append(x)
    return path


def blocks_of(page: str) -> list[Block]:
    """(text, path, characters inside links) of every leaf block with text, in page order.

    Comments, markup and silent elements give nothing; silent ones split no block.  Unclosed elements, silent ones too,
    end where a parent ends; a block-level start tag ends an open paragraph, and an item ends the item before it.
    Time and memory are in proportion to the page, however deep its elements are nested.
    """
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    link_depth, linked = 0, 0

    def top() -> Path:
        return stack[-1][1] if stack else TOP

    def pop() -> str:
        tag, _ = stack.pop()
        opened[tag] -= 1
        return tag

    def flush() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            t = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if t:
                path = next((p for _, p in reversed(stack) if not p.silent), TOP) if top().silent else top()
                out.append((t, path, linked))
            text.clear()
        linked = 0

    position, n = 0, len(page)
    while position < n:
        m = _TOKEN.match(page, position)
        tok, position = m.group(), m.end()
        if tok[0] != "<" or tok == "<":
            if not top().silent:
                text.append(tok)
                if link_depth:
                    linked += len(tok)
            continue
        if tok[1] in "!?":
            if tok.startswith("<![CDATA[") and not top().silent:
                text.append(tok[9:].removesuffix("]]>"))
            continue
        tag = _NAME.match(tok).group(1).lower()
        closing = tok[1] == "/"
        if tag in INLINE:
            if tag == "a":
                link_depth = max(0, link_depth - 1) if closing else link_depth + 1
            elif tag == "br" and not top().silent:
                text.append(" ")
            continue
        if tag in RAW:
            if not closing and not tok.endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, position)
                position = end.end() if end else n
            continue
        if closing:
            if opened[tag] > 0:
                if not (top().silent and next(x for t, x in reversed(stack) if t == tag).silent):
                    flush()
                    link_depth = 0
                while pop() != tag:
                    pass
            elif tag not in SILENT:
                flush()
                link_depth = 0
            continue
        if tag in SILENT or top().silent:
            if tag == "option" and stack and stack[-1][0] == "option":
                pop()
            if tag not in VOID and not tok.endswith("/>"):
                stack.append((tag, top()._replace(silent=True)))
                opened[tag] += 1
            continue
        flush()
        link_depth = 0
        if stack and (stack[-1][0] == "p" or stack[-1][0] == tag in ("li", "dt", "dd", "tr", "td", "th")):
            pop()
        if tag in VOID or tok.endswith("/>"):
            continue
        names = [tag]
        if "=" in tok:
            for a in _ATTRIBUTE.finditer(tok):
                names += name_parts(a.group(2) or a.group(3) or a.group(4) or "")
        stack.append((tag, top().below(tuple(names))))
        opened[tag] += 1
    flush()
    return out


def weak_labels(page: list[Block], repeated: frozenset[str] = frozenset()) -> list[int]:
    """1 for main text.  repeated: texts that stand on several sampled pages.

    Elements that say what they hold decide.  In others sentences are main text, repeated texts and links are not, and
    the rest follows the sentences of its container.
    """
    sure: list[int | None] = []
    for t, path, linked in page:
        if path.side or path.main:
            sure.append(int(not path.side))
        elif t in repeated or linked > LINK_SHARE * len(t):
            sure.append(0)
        else:
            sure.append(1 if t[-1] in _ENDS and word_count(t) >= SENTENCE_WORDS else None)
    votes: Counter[int] = Counter()
    for x, (_, path, _) in zip(sure, page, strict=True):
        votes[path.parent] += 0 if x is None else 2 * x - 1
    return [int(votes[path.parent] > 0) if x is None else x for x, (_, path, _) in zip(sure, page, strict=True)]


def vectors(pages: list[list[Block]], places: np.ndarray | None = None) -> np.ndarray:
    """One row for each block of the pages, in order: hashed path, hashed words, sizes.

    places: where each block lies in its page, from 0 to 1, if the pages given are runs of longer ones.
    """
    flat = [b for p in pages for b in p]
    out = np.zeros((len(flat), PATH_DIMS + WORD_DIMS + SIZE_DIMS), np.float32)
    if not flat:
        return out
    known: dict[tuple[int, str], np.ndarray] = {}
    for row, (_, path, _) in zip(out, flat, strict=True):
        v = known.get((path.bits, path.leaf))
        if v is None:
            bits = path.bits | (1 << zlib.crc32(("leaf:" + path.leaf).encode()) % PATH_DIMS if path.leaf else 0)
            v = known[path.bits, path.leaf] = np.unpackbits(np.frombuffer(bits.to_bytes(PATH_DIMS // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
        row[:PATH_DIMS] = v
    for a, z, data, own in C.chunks(pa.array([t for t, _, _ in flat], pa.large_string())):
        w = C.Words(data, own, fold_case=True)
        counts = np.bincount(w.doc * WORD_DIMS + (w.hashes >> np.uint64(40)).astype(np.int64) % WORD_DIMS, minlength=(z - a) * WORD_DIMS).reshape(z - a, WORD_DIMS)
        out[a:z, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.maximum(w.counts, 1)[:, None]
        out[a:z, -1] = np.log1p(w.counts) / 6
        out[a:z, -2] = np.log1p(np.diff(own)) / 8
    out[:, -3] = np.minimum(1, [k / max(1, len(t)) for t, _, k in flat])
    out[:, -4] = [t[-1] in _ENDS for t, _, _ in flat]
    unspaced = [k for k, (t, _, _) in enumerate(flat) if not t.isascii() and _UNSPACED.search(t)]
    out[unspaced, -1] = np.log1p([word_count(flat[k][0]) for k in unspaced]) / 6
    out[:, -5] = [min(p.depth, 100) / 10 for _, p, _ in flat]
    out[:, -6] = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages]) if places is None else places
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for every block."""

    def __init__(self, seed: int = 11):
        rng, d, h = np.random.default_rng(seed), PATH_DIMS + WORD_DIMS + SIZE_DIMS, HIDDEN
        make = lambda *s: (rng.normal(size=s) * (1 / np.sqrt(s[0]))).astype(np.float32)
        self.w = {}
        for k in "fb":
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.w |= {f"{k}x": make(d, 4 * h), f"{k}h": make(h, 4 * h), f"{k}0": bias}
        self.w |= {"o": make(2 * h, 1)[:, 0], "o0": np.zeros(1, np.float32)}

    def _direction(self, k: str, x: np.ndarray, mask: np.ndarray, keep: bool, start: tuple | None = None):
        """x: (time, pages, dims) in reading order, from start; returns (time, pages, HIDDEN), what training needs, the end."""
        t, b, _ = x.shape
        h = HIDDEN
        given = (x.reshape(t * b, -1) @ self.w[f"{k}x"] + self.w[f"{k}0"]).reshape(t, b, 4 * h)
        state, cell = start or (np.zeros((b, h), np.float32), np.zeros((b, h), np.float32))
        out, saved = np.zeros((t, b, h), np.float32), []
        for s in range(t):
            z = given[s] + state @ self.w[f"{k}h"]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            m = mask[s][:, None]
            new = f * cell + i * g
            th = np.tanh(new)
            if keep:
                saved.append((i, f, o, g, cell, state, th))
            cell, state = np.where(m, new, cell), np.where(m, o * th, state)
            out[s] = state
        return out, saved, (state, cell)

    def _backward(self, k: str, x: np.ndarray, mask: np.ndarray, saved: list, grad: np.ndarray) -> dict:
        t, b, d = x.shape
        h, wh = HIDDEN, self.w[f"{k}h"]
        dz = np.zeros((t, b, 4 * h), np.float32)
        dstate, dcell, dwh = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32), np.zeros_like(wh)
        for s in range(t - 1, -1, -1):
            i, f, o, g, cell, state, th = saved[s]
            m = mask[s][:, None]
            total = dstate + grad[s]
            ds, dc = np.where(m, total, 0), np.where(m, dcell, 0)
            dc = dc + ds * o * (1 - th**2)
            z = dz[s]
            z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :] = dc * g * i * (1 - i), dc * cell * f * (1 - f), ds * th * o * (1 - o), dc * i * (1 - g**2)
            dwh += state.T @ z
            dstate = np.where(m, z @ wh.T, total)
            dcell = np.where(m, dc * f, dcell)
        flat = dz.reshape(t * b, -1)
        return {f"{k}x": x.reshape(t * b, d).T @ flat, f"{k}h": dwh, f"{k}0": flat.sum(0)}

    def _run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, sf, _ = self._direction("f", x, mask, keep)
        b, sb, _ = self._direction("b", x[::-1], mask[::-1], keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        return self._labels(both), both, sf, sb

    def _labels(self, both: np.ndarray) -> np.ndarray:
        return _sigmoid(both @ self.w["o"] + self.w["o0"])

    def probabilities(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Of every block of every page; pages of like length are read together."""
        out = [np.zeros(len(s), np.float32) for s in sequences]
        order = sorted((p for p, s in enumerate(sequences) if len(s)), key=lambda p: len(sequences[p]))
        at = 0
        while at < len(order):
            group = order[at : at + 256]
            group = group[: max(1, (1 << 14) // len(sequences[group[-1]]))]
            at += len(group)
            x, mask = _padded([sequences[p] for p in group])
            got = self._run(x, mask)[0]
            for k, p in enumerate(group):
                out[p] = got[: len(sequences[p]), k]
        return out

    def long_page(self, page: list[Block]) -> np.ndarray:
        """Probabilities of one page of any length: each direction reads run after run and carries its state."""
        n = len(page)
        runs = [(a, min(a + RUN, n)) for a in range(0, n, RUN)]
        both = np.zeros((n, 2 * HIDDEN), np.float32)
        for k, way, columns in (("f", 1, slice(0, HIDDEN)), ("b", -1, slice(HIDDEN, 2 * HIDDEN))):
            state = None
            for a, z in runs[::way]:
                x = vectors([page[a:z]], np.arange(a, z) / n)[::way, None]
                out, _, state = self._direction(k, x, np.ones((z - a, 1), bool), False, state)
                both[a:z, columns] = out[::way, 0]
        return self._labels(both)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probabilities of every block of the pages, with few vectors in memory at a time."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(pages):
            to, blocks = at, 0
            while to < len(pages) and (to == at or blocks + len(pages[to]) <= 2 * RUN):
                blocks += len(pages[to])
                to += 1
            if blocks > 2 * RUN:
                out.append(self.long_page(pages[at]))
            else:
                flat = vectors(pages[at:to])
                stops = np.cumsum([len(p) for p in pages[at:to]])
                out += self.probabilities([flat[z - len(p) : z] for p, z in zip(pages[at:to], stops, strict=True)])
            at = to
        return out

    def train(self, sequences: list[np.ndarray], labels: list[np.ndarray], seed: int = 3) -> None:
        """Adam on the mean log loss of blocks; sequences are pages, long ones in pieces of RUN blocks."""
        rng, step = random.Random(seed), 0
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        order = [k for k in range(len(sequences)) if len(sequences[k])]
        for _ in range(EPOCHS):
            rng.shuffle(order)
            order.sort(key=lambda k: len(sequences[k]))  # stable: batches of like length, mixed anew each time
            batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
            rng.shuffle(batches)
            for pick in batches:
                x, mask = _padded([sequences[k] for k in pick])
                y = _padded([labels[k][:, None].astype(np.float32) for k in pick])[0][:, :, 0]
                p, both, sf, sb = self._run(x, mask, keep=True)
                d = np.where(mask, p - y, 0).astype(np.float32) / max(1, mask.sum())
                grads = {"o": np.einsum("tb,tbh->h", d, both), "o0": np.array([d.sum()], np.float32)}
                up = d[:, :, None] * self.w["o"]
                grads |= self._backward("f", x, mask, sf, up[:, :, :HIDDEN]) | self._backward("b", x[::-1], mask[::-1], sb, up[::-1, :, HIDDEN:])
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(s) for s in sequences)
    x, mask = np.zeros((t, len(sequences), sequences[0].shape[1]), np.float32), np.zeros((t, len(sequences)), bool)
    for k, s in enumerate(sequences):
        x[: len(s), k], mask[: len(s), k] = s, True
    return x, mask


def rearranged(article: list[Block], rng: random.Random) -> list[tuple[Block, int]]:
    """Blocks and labels of an article in another container, with boilerplate of other kinds before, in and after it.

    Containers have a name with meaning, another name, or none; boilerplate in the latter is of links and short texts.
    """
    words = " ".join(t for t, _, _ in article).split() or ["text"]
    phrase = lambda low, high: " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))
    blank = lambda: "." + "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 7)))
    shells = [("article",), ("main",), ("div", ".content"), ("section", ".post"), ("div", ".article"), ("main", "article"), ("div", ".entry", ".content"), ("div", ".story")]
    plain = [("div",), ("section",), ("div", blank()), ("section", blank()), ("div", blank(), blank()), ("div", "div", blank())]
    outer = [(), ("div",), ("div", ".container"), ("div", ".page"), ("div", ".wrapper"), ("div", blank()), ("div", ".page", blank()), ("div", blank(), blank()), ("div", blank(), "div", blank()), ("div", ".site"), ("div", ".page", ".site")]
    shell, around = rng.choice(shells if rng.random() < 0.6 else plain), ("html", "body", *rng.choice(outer))
    leaf = lambda x: x if x in ("h1", "h2", "h3", "li", "blockquote", "pre", "td", "p", "figcaption") else "p"
    inner = ("section",) if rng.random() < 0.2 else ()
    inside_of = {"li": rng.choice([("ul",), ("ol",)]), "td": ("table", "tr"), "figcaption": ("figure",)}
    part = lambda x: (*inside_of.get(x, ()), x)
    mine = [((t, path_of(*around, *shell, *inner, *part(leaf(path.leaf))), k), 1) for t, path, k in article]
    # Headings, lists and tables of the article's own, short as they are.
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        kind = rng.choice([("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("table", "tr", "td"), ("table", "tbody", "tr", "td"), ("blockquote", "p"), ("figure", "figcaption"), ("dl", "dd"), ("pre",)])
        own = [((phrase(1, 9), path_of(*around, *shell, *inner, *kind), 0), 1) for _ in range(1 if kind[0][0] in "hfbp" else rng.randint(2, 6))]
        at = rng.randint(min(1, len(mine)), len(mine))
        mine[at:at] = own

    def side(inside: tuple[str, ...]) -> list[tuple[Block, int]]:
        name, made = rng.choice(sorted(SIDE_NAMES)), []
        box = rng.choice([(rng.choice(sorted(SIDE_TAGS - {"header"})),), ("div", f".{name}"), ("section", f".{name}"), ("ul", f".{name}"), ("aside", f".{name}")])
        named = rng.random() < 0.75
        if not named:
            box = rng.choice([("div", blank()), ("ul",), ("div",), ("ul", blank())])
        for _ in range(rng.choice([1, 1, 2, 4, 8]) if named else rng.choice([3, 5, 8])):
            t = phrase(1, 4) if rng.random() < 0.5 or not named else phrase(5, 60) + "."
            made.append(((t, path_of(*inside, *box, *rng.choice([(), ("p",), ("ul", "li"), ("div",), ("li",), ("h2",)])), len(t) if rng.random() < 0.4 or not named else 0), 0))
        return made

    out = [x for _ in range(rng.randint(0, 3)) for x in side(around)]
    cut = rng.randint(0, len(mine))
    out += mine[:cut] + (side((*around, *shell)) if rng.random() < 0.8 else []) + mine[cut:]
    return out + [x for _ in range(rng.randint(0, 3)) for x in side(around)]


def train(pages: DataFrame, html_column: str = "html", id_column: str = "page_id") -> Labeller:
    """A labeller from about SAMPLE_PAGES pages, chosen by a hash of their ids."""
    n = pages.count()
    place = F.pmod(F.xxhash64(F.col(id_column), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = pages.where(place < min(1.0, SAMPLE_PAGES / max(1, n))).select(id_column, html_column).collect()
    rng = random.Random(29)
    real = [blocks_of(h) for _, h in sorted((str(i), h or "") for i, h in chosen)]
    on_pages = Counter(t for p in real for t in {t for t, _, _ in p})
    repeated = frozenset(t for t, k in on_pages.items() if k > 2)
    made = [list(zip(p, weak_labels(p, repeated), strict=True)) for p in real]
    articles = [[b for b, x in p if x] for p in made if any(x for _, x in p)]
    articles = articles or [[("text. " * k, path_of("html", "body", "article", "p"), 0) for k in range(1, 9)]]
    made += [rearranged(p, rng) for p in articles for _ in range(COPIES)]
    while len(made) < 1200:
        made.append(rearranged(rng.choice(articles), rng))
    made = [p[a : a + RUN] for p in made for a in range(0, len(p), RUN)]
    model = Labeller()
    model.train([vectors([[b for b, _ in p]]) for p in made], [np.array([x for _, x in p]) for p in made])
    return model


def extract(pages: DataFrame, model: Labeller, html_column: str = "html", id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    text joins the blocks labelled as main text in page order by one line end; null or empty html, and pages without
    such blocks, have an empty one.  Pages are read whole, with all their blocks as context, whatever their length.
    Repeated rows stay; other columns are not read.
    """
    spark = pages.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                cut = [blocks_of(h or "") for h in part.column(2).to_pylist()]
                texts = ["\n".join([t for (t, _, _), x in zip(p, q, strict=True) if x >= 0.5]) for p, q in zip(cut, m.label(cut), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_column, url, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select(id_column, url, html_column).mapInArrow(run, f"`{id_column}` {kinds[id_column]}, `{url}` {kinds[url]}, text string, n_chars long")


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))


SQL: dict[str, str] = {}
QUERIES = {"op6_html_extract": op6_html_extract}
