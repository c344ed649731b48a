"""Toxic spans by a linear-chain conditional random field over words.

Two states, clean and toxic.  A word's score for the toxic state is the sum of
hashed features (the word, prefixes of 3-6 letters, a suffix), to which the chain
adds start and transition scores.  Exact forward-backward gives each word's
marginal; a document's score is a logistic function of its marginals (largest,
sum, number over one half), and words over one half are its offending spans.

Token labels come from document labels: in toxic documents, words whose form or
prefix occurs significantly often there (a Chernoff bound over all candidates)
are the toxic ones, all others and all of clean documents are clean.

Fitting takes every labelled row that isn't held out, with its whole text.  The
texts are read once and kept in a scratch table as blocks of word ids
(``Block``), cut into segments of 32 words for the chain; counts, gradients and the
steps of the document score are sums over all blocks, added up a task and then on
the driver (``Spread``; a few blocks stay on the driver: ``Gathered``).  Scoring
reads every whole text.  Labels, lang, source and doc_id are never features.

Edge cases: a null or empty text, and one without words, gets the score of no
evidence; without any usable label of one class, every score is the prior;
repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded, discard, fresh, materialize, whole

WORD = re.compile(r"\w+")
LATIN = bytes(ord(chr(c).lower()) if WORD.match(chr(c)) else 32 for c in range(256))  # of Latin-1: lower case, and spaces between words
BITS = 18
SEGMENT = 32
NAMES = 6  # features of a word, at most
NO_FEATURE = 1 << BITS
BLOCK_WORDS = 250_000
GATHERED_BLOCKS = 8


def words_of(text: str) -> list[str]:
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return list(map(str.lower, WORD.findall(text)))


def units(word: str) -> list[str]:
    """The forms of a word that can carry a label: itself and its prefixes."""
    return [word, *(f"{word[:k]}~" for k in (4, 5, 6) if len(word) > k)]


def feature_ids(word: str) -> list[int]:
    names = [f"w={word}", *(f"p={word[:k]}" for k in (3, 4, 5, 6) if len(word) >= k), f"s={word[-3:]}"]
    mask = (1 << BITS) - 1
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & mask for n in names]


def _crc_table() -> np.ndarray:
    t = np.arange(256)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ 0xEDB88320, t >> 1)
    return t


CRC = _crc_table()


def _crc_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC[(state ^ byte) & 255] ^ state >> 8


def _crc_char(state: np.ndarray, char: np.ndarray) -> np.ndarray:
    """States of crc32 after a character's UTF-8, of two bytes at most."""
    wide = np.flatnonzero(char >= 0x80)
    if not len(wide):
        return _crc_step(state, char)
    out = _crc_step(state, np.where(char < 0x80, char, 0xC0 | char >> 6))
    out[wide] = _crc_step(out[wide], 0x80 | char[wide] & 63)
    return out


def features_of(words: list[str]) -> np.ndarray:
    """``feature_ids`` of many words, NAMES rows; NO_FEATURE where a word has no such prefix."""
    out = np.full((NAMES, len(words)), NO_FEATURE, np.int32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    at = np.cumsum(sizes) - sizes
    rare = sizes > 40
    rare[np.searchsorted(at + sizes, np.flatnonzero(chars >= 0x800), "right")] = True
    for i in np.flatnonzero(rare).tolist():
        f = feature_ids(words[i])
        out[: len(f), i] = f
    order = np.argsort(-sizes, kind="stable")
    order = order[~rare[order]]
    size, at = sizes[order], at[order]
    longer = len(size) - np.searchsorted(size[::-1], np.arange(42), "right")  # words of over so many characters come first

    def begin(name: bytes) -> np.ndarray:
        return np.full(len(size), zlib.crc32(name) ^ 0xFFFFFFFF)

    def ids(state: np.ndarray) -> np.ndarray:
        return (state ^ 0xFFFFFFFF) & ((1 << BITS) - 1)

    word, prefix, suffix = begin(b"w="), begin(b"p="), begin(b"s=")
    tail = np.maximum(size - 3, 0)
    for k in range(40):
        n = longer[k]
        if not n:
            break
        c = chars[at[:n] + k]
        word[:n] = _crc_char(word[:n], c)
        if k < 6:
            prefix[:n] = _crc_char(prefix[:n], c)
            if k >= 2:
                out[k - 1, order[:n]] = ids(prefix[:n])
        if k < 3:
            suffix[:n] = _crc_char(suffix[:n], chars[at[:n] + tail[:n] + k])
    out[0, order], out[NAMES - 1, order] = ids(word), ids(suffix)
    return out


class Emissions:
    """Toxic-state scores of words, remembered in two bounded generations."""

    def __init__(self, weights: np.ndarray, bias: float, limit: int = 300_000):
        self.w, self.bias, self.limit = np.append(weights, weights.dtype.type(0)), bias, limit
        self.new: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def of(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.new.get, words, repeat(np.nan)), np.float64, len(words))
        at = np.flatnonzero(np.isnan(out))
        if len(at):
            asked = [words[i] for i in at.tolist()]
            got = {w: self.old.get(w) for w in asked}
            unknown = [w for w, v in got.items() if v is None]
            got.update(zip(unknown, (self.bias + self.w[features_of(unknown)].sum(axis=0).astype(np.float64)).tolist(), strict=True))
            out[at] = list(map(got.__getitem__, asked))
            if len(self.new) + len(got) > self.limit:
                self.old, self.new = self.new, {}
            self.new.update(islice(got.items(), self.limit))
        return np.clip(out, -30, 30)


def marginals(e: np.ndarray, first: np.ndarray, start: float, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each word of many documents laid end to end.

    ``first`` marks where a document starts: there, both rows of the step matrix
    are the start scores, which forgets what came before in either direction.
    The words are cut into blocks whose step products are taken side by side; a
    short loop joins the blocks.  Then forward and backward scores go through all
    blocks, as ratios of the toxic to the clean state.  Exact, whatever the block length.
    """
    n = len(e)
    if not n:
        return np.zeros(0)
    step = 64
    blocks = -(-n // step)
    x, begins = np.ones(blocks * step), np.zeros(blocks * step, bool)
    np.exp(e, out=x[:n])
    begins[:n] = first
    begins[n : n + 1] = True  # padding: a document of its own
    x = np.ascontiguousarray(x.reshape(blocks, step).T)
    place, of = np.nonzero(begins.reshape(blocks, step).T)
    cuts = np.searchsorted(place, np.arange(step + 1))
    new = [of[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    (t00, t01), (t10, t11) = np.exp(trans).tolist()
    s = math.exp(start)
    p = np.zeros((2, 2, blocks))  # by the state before the block and the one reached
    p[0, 0] = p[1, 1] = 1.0
    for k in range(step):
        zero, one = p[:, 0] * t00 + p[:, 1] * t10, (p[:, 0] * t01 + p[:, 1] * t11) * x[k]
        if len(new[k]):
            zero[:, new[k]] = both = p[:, 0, new[k]] + p[:, 1, new[k]]
            one[:, new[k]] = both * (s * x[k, new[k]])
        p[:, 0], p[:, 1] = zero, one
        if k % 4 == 3:
            p /= p.max(axis=(0, 1))
    p00, p01, p10, p11 = p.reshape(4, blocks).tolist()
    fwd, bwd = [0.0] * blocks, [1.0] * blocks
    for i in range(blocks - 1):
        r = fwd[i]
        fwd[i + 1] = (p01[i] + r * p11[i]) / (p00[i] + r * p10[i])
    for i in range(blocks - 1, 0, -1):
        r = bwd[i]
        bwd[i - 1] = (p10[i] + p11[i] * r) / (p00[i] + p01[i] * r)
    out = np.empty((step, blocks))
    r = np.array(fwd)
    for k in range(step):
        r = x[k] * (t01 + t11 * r) / (t00 + t10 * r)
        r[new[k]] = s * x[k, new[k]]
        out[k] = r
    r = np.array(bwd)
    for k in range(step - 1, -1, -1):
        out[k] *= r
        r = x[k] * r
        r = (t10 + t11 * r) / (t00 + t01 * r)
        r[new[k]] = 1.0
    out /= 1 + out
    return out.T.reshape(-1)[:n]


def evidence(m: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What a document's score is made of, a row each."""
    out = np.zeros((len(sizes), 3))
    out[:, 0] = -12.0
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        top = np.clip(np.maximum.reduceat(m, at), 1e-6, 1 - 1e-6)
        out[full, 0] = np.clip(np.log(top / (1 - top)), -12, 12)
        out[full, 1] = np.log1p(np.add.reduceat((m >= 0.5).astype(float), at))
        out[full, 2] = np.log1p(np.add.reduceat(m, at))
    out[:, 0] /= 6
    return out


class Block(NamedTuple):
    """Whole documents as word ids, the segments side by side."""

    ids: np.ndarray  # first words of all segments, then second ones, and so on; longer segments first
    alive: np.ndarray  # segments that have a first word, a second one, and so on
    base: np.ndarray  # place of each segment's first word in the documents laid end to end
    sizes: np.ndarray  # words of each document
    labels: np.ndarray  # of each document
    words: np.ndarray  # the forms by id, in UTF-8, ended by line feeds
    features: np.ndarray  # of all forms the word's, then the suffix's, then those of the prefixes of 6, 5, 4 and 3 letters as a tree
    levels: np.ndarray  # nodes of each of these four levels; NO_FEATURE where words are shorter
    nodes: np.ndarray  # each form's node of the first level, then how many nodes are below those of the next ones

    def forms(self) -> list[str]:
        return self.words.tobytes().decode("utf-8", "surrogatepass").split("\n")[:-1]

    def number(self) -> int:
        """How many forms there are, by the features."""
        return (len(self.features) - int(self.levels.sum())) // 2

    def of_forms(self, w: np.ndarray) -> np.ndarray:
        """The sum of each form's feature weights."""
        v, n, up = w[self.features], self.number(), 0
        cuts = (2 * n + np.r_[0, np.cumsum(self.levels)]).tolist()
        below = self.nodes[n:]
        for k in (3, 2, 1):
            up = np.repeat(v[cuts[k] : cuts[k + 1]] + up, below[cuts[k] - cuts[1] : cuts[k + 1] - cuts[1]])
        return v[:n] + v[n : 2 * n] + (v[cuts[0] : cuts[1]] + up)[self.nodes[:n]]

    def of_features(self, by_form: np.ndarray, room: int) -> np.ndarray:
        """The sum of each feature's forms."""
        n = self.number()
        up = np.bincount(self.nodes[:n], by_form, int(self.levels[0]))
        values = [by_form, by_form, up]
        for below in np.split(self.nodes[n:].astype(np.int64), np.cumsum(self.levels[1:3])):
            if len(below):
                up = np.add.reduceat(up, np.cumsum(below) - below)
            values.append(up)
        return np.bincount(self.features, np.concatenate(values), room)


TYPES = dict(zip(Block._fields, ("<u4", "<i8", "<i8", "<i8", "<i8", "<u1", "<i4", "<i8", "<u4"), strict=True))
WEIGHED = ["features", "levels", "nodes"]


def _pack(block: Block) -> list[bytes]:
    out = [np.asarray(x, TYPES[n]).tobytes() for n, x in zip(Block._fields, block, strict=True)]
    if block.number() < 1 << 16:
        out[0], out[-1] = block.ids.astype("<u2").tobytes(), block.nodes.astype("<u2").tobytes()
    return out


def _unpack(columns: dict[str, pa.Array], row: int) -> Block:
    """A block with those of its arrays that are there; ids come with ``alive`` and nodes with ``levels``, which tell their width."""
    got = {n: columns[n][row].as_buffer() for n in columns}
    types = dict(TYPES)
    if "ids" in got and got["ids"].size == 2 * int(np.frombuffer(got["alive"], TYPES["alive"]).sum()):
        types["ids"] = "<u2"
    if "nodes" in got:
        levels = np.frombuffer(got["levels"], TYPES["levels"])
        if got["nodes"].size == got["features"].size // 4 - int(levels.sum()) + 2 * int(levels[1:].sum()):
            types["nodes"] = "<u2"
    none = np.zeros(0, np.int64)
    return Block(*(np.frombuffer(got[n], t) if n in got else none for n, t in types.items()))


def _tree(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features, levels and nodes of a block, of what ``features_of`` gives."""
    top, low = f[1].astype(np.int64) << 38 | f[2].astype(np.int64) << 19 | f[3], f[4]
    order = np.lexsort((low, top))
    top, low = top[order], low[order]
    change = top[1:] != top[:-1]
    changes = [change | (low[1:] != low[:-1]), change, top[1:] >> 19 != top[:-1] >> 19, top[1:] >> 38 != top[:-1] >> 38]
    first = [np.flatnonzero(np.r_[True, c][: len(top)]) for c in changes]
    ids = [low[first[0]], *(top[at] >> bits & ((1 << 19) - 1) for at, bits in zip(first[1:], (0, 19, 38), strict=True))]
    node = np.empty(len(top), np.int64)
    node[order] = np.cumsum(np.r_[0, changes[0]])[: len(top)]
    below = [np.diff(np.r_[np.searchsorted(a, b), len(a)]) if len(b) else b for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate([f[0], f[5], *ids]).astype(np.int32), np.array([len(x) for x in first]), np.concatenate([node, *below])


def blocks_of(docs: Iterable[tuple[str, int]], most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The blocks of (text, label) rows: ``most`` words, or a document."""

    def block() -> Block:
        sizes = np.array([len(d) for d in held], np.int64)
        flat, first = np.concatenate(held), np.cumsum(sizes) - sizes
        n = -(-sizes // SEGMENT)
        within = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(sizes, n) - within)
        order = np.argsort(-length, kind="stable")
        base = (np.repeat(first, n) + within)[order]
        alive = len(length) - np.searchsorted(np.sort(length), np.arange(SEGMENT), "right")
        ids = np.concatenate([flat[base[:m] + k] for k, m in enumerate(alive)])
        words = "".join([w + "\n" for w in types]).encode("utf-8", "surrogatepass")
        return Block(ids, alive, base, sizes, np.array(labels, np.int64), np.frombuffer(words, np.uint8), *_tree(features_of(list(types))))

    types: defaultdict[str, int] = defaultdict(count().__next__)
    held, labels, n = [], [], 0
    for text, label in docs:
        words = words_of(text)
        held.append(np.fromiter(map(types.__getitem__, words), np.uint32, len(words)))
        labels.append(int(label))
        n += len(words)
        if n >= most or len(held) >= most:
            yield block()
            types = defaultdict(count().__next__)
            held, labels, n = [], [], 0
    if held:
        yield block()


def _stable(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers under ``most``, 16 bits at a time, which numpy sorts in linear time."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if most > 1 << 16:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _firsts(doc: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
    """Which rows are the first of their (document, unit); documents ascend."""
    order = _stable(unit, most)
    d, u = doc[order], unit[order]
    out = np.zeros(len(doc), bool)
    out[order[np.r_[True, (d[1:] != d[:-1]) | (u[1:] != u[:-1])][: len(d)]]] = True
    return out


def form_units(block: Block) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """What ``units`` gives of all forms: (units in UTF-8, which of them each form has, -1 for none), by kind."""
    raw = block.words
    char = np.flatnonzero((raw & 0xC0) != 0x80)
    ends = np.flatnonzero(raw[char] == 10)  # of the forms, among all characters
    first = np.r_[0, ends + 1][: len(ends)]
    chars, many = ends - first, len(ends)

    def cut(of: np.ndarray, size: np.ndarray | int, mark: bytes) -> pa.Array:
        begin, end = char[first[of]], char[first[of] + size]
        at = np.r_[0, np.cumsum(end - begin + len(mark))]
        data = raw[np.arange(at[-1]) + np.repeat(begin - at[:-1], np.diff(at))]
        if mark:
            data[at[1:] - 1] = mark[0]
        return pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])

    yield cut(np.arange(many), chars, b""), np.arange(many)
    for k in (4, 5, 6):
        of = np.flatnonzero(chars > k)
        got = cut(of, k, b"~").dictionary_encode()
        unit = np.full(many, -1)
        unit[of] = got.indices.to_numpy()
        yield got.dictionary, unit


def unit_counts(block: Block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(units in UTF-8, toxic documents, clean documents that have each)."""
    form = np.empty(len(block.ids), np.int64)
    form[np.concatenate([block.base[:m] + k for k, m in enumerate(block.alive)])] = block.ids
    doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
    toxic = block.labels == 1
    names, counts = [], []
    for units, of in form_units(block):
        u = of[form]
        d, u = doc[u >= 0], u[u >= 0]
        keep = _firsts(d, u, len(units))
        if not names:
            doc, form = doc[keep], form[keep]
        names.append(units)
        counts.append(np.bincount(u[keep] * 2 + toxic[d[keep]], minlength=2 * len(units)))
    clean, bad = np.concatenate(counts).reshape(-1, 2).T
    return pa.concat_arrays(names), bad, clean


def significant(k: int, clean: int, p: float, need: float) -> bool:
    """Whether a unit is in more toxic documents (``k``) than chance gives, by a Chernoff bound."""
    n = k + clean
    r = k / n
    kl = r * math.log(r / p) + ((1 - r) * math.log((1 - r) / (1 - p)) if r < 1 else 0)
    return r > max(0.5, p) and n * kl >= need


class Gathered:
    """Blocks in memory."""

    def __init__(self, blocks: Iterable[Block]):
        self.blocks = list(blocks)

    def total(self, f: Callable[[Block], np.ndarray], columns: list[str], dtype: str = "<f8") -> np.ndarray:
        """The sum of ``f`` over all blocks; it uses no arrays but ``columns``."""
        return sum((f(b) for b in self.blocks), np.zeros(1))

    def units(self, least: int, share: float) -> tuple[int, list[tuple[str, int, int]]]:
        """(units of toxic documents, those in ``least`` or more and in over ``share`` of their documents with the counts of toxic and clean ones)."""
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for b in self.blocks:
            names, t, c = unit_counts(b)
            for u, x, y in zip((v.decode("utf-8", "surrogatepass") for v in names.to_pylist()), t.tolist(), c.tolist(), strict=True):
                toxic[u] += x
                clean[u] += y
        return sum(k > 0 for k in toxic.values()), [(u, k, clean[u]) for u, k in toxic.items() if k >= least and k > share * (k + clean[u])]

    def evidence(self, model: Model) -> Gathered:
        """Blocks whose ``base`` is the documents' evidence."""
        return Gathered([_with_evidence(b, model) for b in self.blocks])

    def drop(self) -> None:
        self.blocks = []


class Model:
    """A fitted chain and its document score; plain arrays, so it pickles small."""

    def __init__(self, weights: np.ndarray, bias: float, start: float, trans: np.ndarray, doc: np.ndarray):
        self.weights, self.bias, self.start, self.trans, self.doc = weights, bias, start, trans, doc

    def score(self, docs: list[list[str]], emissions: Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document scores, marginals end to end, sizes)."""
        sizes = np.array([len(d) for d in docs], np.int64)
        e = emissions.of([w for d in docs for w in d])
        first = np.zeros(len(e), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        m = marginals(e, first, self.start, self.trans)
        z = np.c_[np.ones(len(docs)), evidence(m, sizes)] @ self.doc
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), m, sizes


def fit(texts: list[str], labels: list[int], rounds: int = 60) -> Model:
    """Fit chain and document score on texts in memory."""
    return fit_blocks(Gathered(blocks_of(zip(texts, labels, strict=True))), rounds)


def fit_blocks(data: Gathered | Spread, rounds: int = 60, least: int = 5) -> Model:
    """Fit chain and document score on all documents of ``data``."""
    n, positive, words = (int(v) for v in np.zeros(3) + data.total(lambda b: np.array([len(b.labels), b.labels.sum(), b.sizes.sum()], float), ["labels", "sizes"]))
    prior = (positive + 0.5) / (n + 1)
    base = math.log(max(prior, 1e-4) / max(1 - prior, 1e-4))
    nothing = Model(np.zeros(1 << BITS, np.float32), -6.0, 0.0, np.zeros((2, 2)), np.array([base, 0, 0, 0]))
    if not 0 < positive < n:
        return nothing
    p = positive / n
    seen, found = data.units(least, max(0.5, p))
    need = math.log(max(2, seen)) + math.log(100)
    toxic = {u for u, k, clean in found if significant(k, clean, p, need)}
    want = data.total(lambda b: observed(b, toxic), ["ids", "alive", "base", "sizes", "labels", "words", *WEIGHED], "<f4")
    if not toxic or not want[NO_FEATURE + 1]:
        return nothing
    tagged = want[NO_FEATURE + 1]
    # the first step then isn't spent on how rare tagged words are
    w, bias, start, trans = np.zeros(NO_FEATURE + 1), math.log(tagged / max(1.0, words - tagged)), 0.0, np.zeros((2, 2))
    g_w, g_o = np.full(NO_FEATURE + 1, 1e-6), np.full(6, 1e-6)
    for _ in range(rounds):
        at = (w.astype(np.float32), bias, start, trans)
        # a tagged word's share of the gradient is the same however many clean documents there are
        grad = (data.total(lambda b, at=at: expected(b, *at), ["ids", "alive", *WEIGHED], "<f4") - want) / tagged
        grad, other = grad[: NO_FEATURE + 1] + 1e-7 * w, grad[NO_FEATURE + 1 :]
        grad[NO_FEATURE] = 0
        g_w += grad**2
        g_o += other**2
        w -= 0.5 * grad / np.sqrt(g_w)
        move = 0.1 * other / np.sqrt(g_o)
        bias, start, trans = bias - move[0], start - move[1], trans - move[2:].reshape(2, 2)
    model = Model(w[:NO_FEATURE].astype(np.float32), bias, start, trans, np.zeros(4))
    known = data.evidence(model)
    model.doc = _logistic(known)
    known.drop()
    return model


def expected(block: Block, w: np.ndarray, bias: float, start: float, trans: np.ndarray) -> np.ndarray:
    """What the chain expects of the block's segments: toxic words with each feature, in all, at a start, and pairs of states.

    Forward and backward scores are kept as ratios of the toxic to the clean state.
    """
    ids = block.ids.astype(np.intp)
    e = np.clip(bias + block.of_forms(w), -30, 30)
    x = np.exp(e).astype(np.float32)[ids]
    (t00, t01), (t10, t11) = np.exp(trans).astype(np.float32)
    alive = block.alive[block.alive > 0].tolist()
    cuts = np.r_[0, np.cumsum(alive, dtype=np.int64)].tolist()
    r, s = np.empty_like(x), np.ones_like(x)
    if alive:
        r[: alive[0]] = np.float32(math.exp(start)) * x[: alive[0]]
    for k in range(1, len(alive)):
        p = r[cuts[k - 1] : cuts[k - 1] + alive[k]]
        r[cuts[k] : cuts[k + 1]] = x[cuts[k] : cuts[k + 1]] * (t01 + t11 * p) / (t00 + t10 * p)
    pairs = np.zeros((2, 2))
    for k in range(len(alive) - 1, 0, -1):
        u = x[cuts[k] : cuts[k + 1]] * s[cuts[k] : cuts[k + 1]]
        p = r[cuts[k - 1] : cuts[k - 1] + alive[k]]
        clean, toxic = t00 + t01 * u, t10 + t11 * u
        s[cuts[k - 1] : cuts[k - 1] + alive[k]] = toxic / clean
        g = 1 / (clean + p * toxic)
        q = p * g
        pairs += [[t00 * float(g.sum()), t01 * float(g @ u)], [t10 * float(q.sum()), t11 * float(q @ u)]]
    r *= s
    r /= 1 + r
    return _moments(block, np.bincount(ids, r, len(e)), float(r[: alive[0]].sum(dtype=np.float64)) if alive else 0.0, pairs)


def observed(block: Block, toxic: set[str]) -> np.ndarray:
    """What ``expected`` gives, of the block's tags: words with a toxic unit in toxic documents."""
    among = pa.array([u.encode("utf-8", "surrogatepass") for u in toxic], pa.binary())
    flag = np.zeros(block.number(), bool)
    for names, of in form_units(block):
        flag |= np.append(pc.is_in(names, among).to_numpy(zero_copy_only=False), False)[of]
    of_doc = np.searchsorted(np.cumsum(block.sizes), block.base, "right")
    bad = block.labels[of_doc] == 1
    cuts = np.r_[0, np.cumsum(block.alive)]
    tags = [flag[block.ids[a:z]] & bad[: z - a] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    pairs = np.zeros((2, 2))
    for before, now in zip(tags[:-1], tags[1:], strict=True):
        pairs += np.bincount(before[: len(now)] * 2 + now, minlength=4).reshape(2, 2)
    return _moments(block, np.bincount(block.ids, np.concatenate(tags), len(flag)), float(tags[0].sum()), pairs)


def _moments(block: Block, by_form: np.ndarray, starts: float, pairs: np.ndarray) -> np.ndarray:
    out = block.of_features(by_form, NO_FEATURE + 7)
    out[NO_FEATURE + 1 :] = by_form.sum(), starts, *pairs.reshape(-1)
    return out


def _with_evidence(block: Block, model: Model) -> Block:
    """The block's labels, with the evidence of its whole documents as ``base``."""
    w = np.append(model.weights, np.float32(0))
    e = np.clip(model.bias + block.of_forms(w.astype(np.float64)), -30, 30)
    flat = np.empty(len(block.ids))
    place = np.concatenate([block.base[:m] + k for k, m in enumerate(block.alive)])
    flat[place] = e[block.ids]
    first = np.zeros(len(flat), bool)
    first[(np.cumsum(block.sizes) - block.sizes)[block.sizes > 0]] = True
    none = np.zeros(0, np.int64)
    return Block(none, none, evidence(marginals(flat, first, model.start, model.trans), block.sizes).reshape(-1).view(np.int64), none, block.labels, *[none] * 4)


def _logistic(data: Gathered | Spread, l2: float = 1e-2) -> np.ndarray:
    """Weights of a constant and the evidence, by Newton steps."""
    w = np.zeros(4)

    def sums(b: Block, w: np.ndarray) -> np.ndarray:
        x = np.c_[np.ones(len(b.labels)), np.ascontiguousarray(b.base).view(np.float64).reshape(-1, 3)]
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return np.r_[x.T @ (p - b.labels), ((x * (p * (1 - p))[:, None]).T @ x).reshape(-1)]

    for _ in range(30):
        got = data.total(lambda b, w=w: sums(b, w), ["labels", "base"])
        grad = got[:4] + l2 * w
        hess = got[4:].reshape(4, 4) + (l2 + 1e-6) * np.eye(4)
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


# ----- Spark ------------------------------------------------------------------
def held_out(doc_id) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


BLOCKS = ", ".join(f"{n} binary" for n in Block._fields)


class Spread:
    """Blocks in a scratch table, a row each."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.tasks = 2 * table.sparkSession.sparkContext.defaultParallelism

    def total(self, f: Callable[[Block], np.ndarray], columns: list[str], dtype: str = "<f8") -> np.ndarray:
        """The sum of ``f`` over all blocks; it uses no arrays but ``columns``.  A task sends one row."""

        def run(batches):
            out = None
            for b in batches:
                got = dict(zip(columns, b.columns, strict=True))
                for k in range(b.num_rows):
                    v = f(_unpack(got, k))
                    if out is None:
                        out = v
                    else:
                        out += v
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.astype(dtype).tobytes()], pa.binary())], names=["v"])

        rows = bounded(self.table.select(*columns)).coalesce(self.tasks).mapInArrow(run, "v binary").collect()
        return sum((np.frombuffer(r["v"], dtype).astype(np.float64) for r in rows), np.zeros(1))

    def units(self, least: int, share: float) -> tuple[int, list[tuple[str, int, int]]]:
        """As of ``Gathered``."""
        columns = ["ids", "alive", "base", "sizes", "labels", "words"]

        def run(batches):
            for b in batches:
                got = dict(zip(columns, b.columns, strict=True))
                for k in range(b.num_rows):
                    names, toxic, clean = unit_counts(_unpack(got, k))
                    yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["unit", "toxic", "clean"])

        each = bounded(self.table.select(*columns)).mapInArrow(run, "unit string, toxic bigint, clean bigint")
        sums = materialize(each.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0"))
        chosen = sums.where((F.col("toxic") >= least) & (F.col("toxic") > F.lit(share) * (F.col("toxic") + F.col("clean"))))
        out = sums.count(), [tuple(r) for r in chosen.collect()]
        discard(sums)
        return out

    def evidence(self, model: Model) -> Spread:
        """As of ``Gathered``; a new table."""
        columns = ["ids", "alive", "base", "sizes", "labels", *WEIGHED]

        def run(batches):
            for b in batches:
                got = dict(zip(columns, b.columns, strict=True))
                for k in range(b.num_rows):
                    x = _with_evidence(_unpack(got, k), model)
                    yield pa.RecordBatch.from_arrays([pa.array([x.labels.tobytes()], pa.binary()), pa.array([x.base.tobytes()], pa.binary())], names=["labels", "base"])

        return Spread(materialize(bounded(self.table.select(*columns)).mapInArrow(run, "labels binary, base binary")))

    def drop(self) -> None:
        discard(self.table)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the whole texts of all labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    most = BLOCK_WORDS

    def run(batches):
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for block in blocks_of(rows, most):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _pack(block)], names=Block._fields)

    table = materialize(bounded(texts.join(known.hint("merge"), "doc_id").select("text", "toxic")).mapInArrow(run, BLOCKS))
    if table.count() > GATHERED_BLOCKS:
        data = Spread(table)
    else:
        rows = [{n: pa.array([r[n]], pa.binary()) for n in Block._fields} for r in table.collect()]
        data = Gathered(_unpack(r, 0) for r in rows)
    model = fit_blocks(data)
    data.drop()
    discard(table)
    return model


def clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is one half or more; a row without text has the score of no evidence."""
    scored = score(docs, model, id_col, text_col, keep=True)
    return scored.where(F.col(scored.columns[-2]) == 0).select(*docs.columns)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, batch_chars: int = 1_500_000) -> DataFrame:
    """doc_id, score, predicted, spans of every row; with ``keep``, all columns of ``docs`` and those three.

    spans are start:end of offending words, in code points, end exclusive.  With
    ``keep``, the last three columns are the result; where ``docs`` has a column of
    such a name, the result's has an underscore more.
    """
    src = docs if keep else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    names = fresh(docs, "score", "predicted", "spans") if keep else ["score", "predicted", "spans"]
    hidden = fresh(src, "__text")[0]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema] if keep else ["doc_id bigint"]
    src = bounded(src).withColumn(hidden, whole(text_col)) if keep else bounded(src).select("doc_id", whole(text_col).alias(hidden))
    schema = ", ".join([*fields, *(f"`{n}` {t}" for n, t in zip(names, ("double", "int", "string"), strict=True))])
    target = _arrow_schema(schema)

    def run(batches):
        emit = Emissions(model.weights, model.bias)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j]) <= batch_chars):
                    chars += len(texts[j])
                    j += 1
                words = [words_of(t) for t in texts[i:j]]
                p, m, sizes = model.score(words, emit)
                bad = m >= 0.5
                ends = np.cumsum(sizes)
                spans = []
                for k in range(j - i):
                    on = bad[ends[k] - sizes[k] : ends[k]]
                    spans.append(",".join(f"{w.start()}:{w.end()}" for w, o in zip(WORD.finditer(texts[i + k]), on.tolist(), strict=True) if o) if on.any() else "")
                keep_cols = [c.slice(i, j - i) for c in b.columns[:-1]]
                arrays = [*keep_cols, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(arrays, target, strict=True)], schema=target)
                i = j

    return src.mapInArrow(run, schema)
