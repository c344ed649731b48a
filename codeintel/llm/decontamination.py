"""Benchmark decontamination by latent semantic retrieval.

1. *TF-IDF passages.*  Every document is read once; its words become ids of the
   benchmark's vocabulary (0: any other word), kept in a scratch table.  Document
   frequencies are counted over all its passages of 32 words.
2. *Distributed randomised SVD.*  All passages of all documents, as long as query
   passages, and all query passages are the rows of A, of unit length.  Two passes
   apply (A'A) to a random, then to an orthonormal basis, by partial sums a task; a
   small eigenproblem turns the basis into right singular vectors.
3. *Candidates.*  Windows whose idf mass (the sum of squared idf of their benchmark
   words) is a stated part of the least query passage's can hold one.  Every such
   window of every document is projected and compared with all query passages (the
   benchmark cut alike), in blocks: by cosine in the latent space, and by the share
   of the window's whole TF-IDF length that points at the query.
4. *Containment.*  The latent space loses passages as the benchmark grows, and
   items shorter than a window; so beside it stands an exact search
   (``Containment``).  A stretch that passes the checks below holds a least number
   of the item's rarest words; every stretch of every document that does is
   checked, whatever its cosine.  A stretch has the item's length and 24 words
   more; for items shorter than a window, a quarter of its length more.
5. *Checks.*  The longest common subsequence of item and region, in words, over
   the item's length: at least ``lcs`` accepts.  A paraphrase, at least
   ``lcs_answer``, needs the answer too: its words (the item's answer, or its last
   sentence) in order in the region.

The benchmark is the stated query set; it is taken in blocks of at most
``block_items``, so what is broadcast has a bound, whatever its size.

Edge cases: null and empty texts and items match nothing; items of one or two
words are matched only whole, and found in any text where they stand side by side; an item that occurs several times in a document is
one row, the best; rows and items that repeat each count; an empty table or
benchmark gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded, fresh, materialize, text_key, whole

WORD = re.compile(r"\w+")
SCHEMA = "doc_id bigint, item_id bigint, cosine double, lcs_words int, item_words int, lcs double, answer double, first_word int, last_word int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def answer_of(text: str | None) -> list[str]:
    """The words of the last sentence that has any."""
    for part in reversed(re.split(r"[.!?\n]+", text or "")):
        if w := words_of(part):
            return w
    return []


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := where.get(y):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Queries:
    """One block of the benchmark: vocabulary, items, query passages."""

    def __init__(self, rows: list[tuple], passage: int = 24):
        self.passage = passage
        self.vocab: dict[str, int] = {}
        self.items = []
        for item, text, answer in rows:
            words = words_of(text)
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            ans = words_of(answer) if answer else answer_of(text)
            self.items.append((item, ids, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ans]))
        self.dtype = np.dtype("<u2" if len(self.vocab) < 65535 else "<u4")
        owner, spans = [], []
        for k, (_, ids, _) in enumerate(self.items):
            n = len(ids)
            starts = [0] if n <= passage else sorted({*range(0, n - passage, passage // 2), n - passage})
            for s in starts:
                owner.append(k)
                spans.append((s, min(s + passage, n)))
        self.owner, self.spans = np.array(owner, np.int64), spans

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a text's words; 0 for words outside the vocabulary."""
        return array("H" if self.dtype.itemsize == 2 else "I", map(self.vocab.get, words_of(text), repeat(0))).tobytes()


class Containment:
    """Exact candidates: where a stretch can have ``share`` of an item's words in order.

    Of an item of L words a match leaves out at most L - need; so of its
    L - need + k rarest words it has at least k, at different places of the
    stretch.  Each word lists the items it is so rare in.  Stretches of ``reach``
    words are checked as regions that start at multiples of ``step``: every stretch
    lies in one, and none is longer than reach + step - 1 words.
    """

    def __init__(self, queries: Queries, idf: np.ndarray, share: float, hits: int = 1_000_000):
        self.masks: list[dict[int, int]] = []
        size = []
        words, owners, least = [], [], []
        for i, (_, ids, _) in enumerate(queries.items):
            n = len(ids)
            need = next(c for c in range(n + 1) if c / n >= share and c) if n > 2 else n
            k = min(need, max(3, need // 2))
            rare = sorted(ids, key=lambda x: (-idf[x], x))[: n - need + k]
            least.append(k)
            size.append(n)
            for x in set(rare):
                words.append(x)
                owners.append(i)
            mask: dict[int, int] = {}
            for at, x in enumerate(ids):
                mask[x] = mask.get(x, 0) | 1 << at
            self.masks.append(mask)
        n = np.array(size, np.int64)
        long = n >= queries.passage
        self.size, self.least, self.lengths = n, np.array(least, np.int64), size
        self.step = np.where(long, queries.passage // 2, np.maximum(1, n // 4))
        self.reach = np.where(long, n + queries.passage, n + n // 4)
        order = np.argsort(words, kind="stable")
        self.owners = np.array(owners, np.int64)[order]
        self.count = np.bincount(words, minlength=len(idf))
        self.count[0] = 0
        self.first = np.cumsum(self.count) - self.count
        self.gap = int(self.reach.max()) + 1
        self.hits = max(hits, 2 * self.gap * len(n))

    def regions(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, start) of the regions to check, by document."""
        sizes = np.array([len(d) for d in docs], np.int64)
        base = np.cumsum(sizes + self.gap) - sizes - self.gap
        ids = np.concatenate(docs)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(docs)) * self.gap, sizes)
        on = np.flatnonzero(self.count[ids])
        word, place = ids[on], place[on]
        count = self.count[word]
        total = np.cumsum(count)
        span = np.int64(int(base[-1] + sizes[-1]) + 2 * self.gap)
        out, a = [], 0
        while a < len(on):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + self.hits, "right")))
            c = count[a:z]
            within = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            key = self.owners[np.repeat(self.first[word[a:z]], c) + within] * span + np.repeat(place[a:z], c)
            key.sort()
            item = key // span
            end = np.arange(len(key)) + self.least[item] - 1
            ok = end < len(key)
            at, end, item = np.flatnonzero(ok), end[ok], item[ok]
            ok = key[end] - key[at] < self.reach[item]
            at, end, item = at[ok], end[ok], item[ok]
            if len(at):
                p, q = key[at] - item * span, key[end] - item * span
                before = np.where(at > 0, key[at - 1] - item * span, -1)  # of another item: under 0
                doc = np.searchsorted(base, p, "right") - 1
                low = np.maximum(np.maximum(before + 1, q - self.reach[item] + 1), base[doc]) - base[doc]
                step = self.step[item]
                low, high = low // step, (p - base[doc]) // step
                n = high - low + 1
                start = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                doc, item = np.repeat(doc, n), np.repeat(item, n)
                out.append(np.unique((base[doc] + start * self.step[item]) * len(self.size) + item))
            if z >= len(on):
                break
            a = max(a + 1, int(np.searchsorted(place, place[z] - self.gap)))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        at, item = np.divmod(np.unique(np.concatenate(out)), len(self.size))
        doc = np.searchsorted(base, at, "right") - 1
        return doc, item, at - base[doc]

    def common(self, item: int, region: list[int], share: float = 0) -> int:
        """``lcs_length`` of an item and a region; 0 if so few words of the item are in the region that it is under ``share``."""
        size, get = self.lengths[item], self.masks[item].get
        if sum([m.bit_count() for m in map(get, set(region)) if m]) / size < share:
            return 0
        full = v = (1 << size) - 1
        for y in region:
            if m := get(y):
                u = v & m
                v = (v + u | v - u) & full
        return size - v.bit_count()


def _passages(batches: Iterator[pa.RecordBatch], dtype, size: int, words: int = 1_000_000):
    """(ids of many documents end to end, passage of each word, passages), by chunks.

    Passages have ``size`` words; a short rest joins the one before.
    """
    docs, held = [], 0
    for b in batches:
        for x in b.column(0):
            if len(ids := np.frombuffer(x.as_buffer(), dtype)):
                docs.append(ids)
                held += len(ids)
            if held >= words:
                yield _cut(docs, size)
                docs, held = [], 0
    if docs:
        yield _cut(docs, size)


def _cut(docs: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, int]:
    length = np.array([len(d) for d in docs], np.int64)
    n = np.maximum(1, length // size)
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    passage = np.minimum(within // size, np.repeat(n - 1, length)) + np.repeat(np.cumsum(n) - n, length)
    return np.concatenate(docs), passage, int(n.sum())


def _counts(ids: np.ndarray, passage: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, times), in this order, of the terms of each passage."""
    on = np.flatnonzero(ids)
    key = passage[on] * size + ids[on]
    key.sort()
    at = np.flatnonzero(np.diff(key, prepend=-1))
    row, term = np.divmod(key[at], size)
    return row, term, np.diff(at, append=len(key))


def document_frequencies(table: DataFrame, size: int, dtype) -> tuple[np.ndarray, int]:
    """Passages with each term, and passages in all (at index 0)."""

    def run(batches):
        df = np.zeros(size + 1, np.int64)
        for ids, passage, n in _passages(batches, dtype, 32):
            df += np.bincount(_counts(ids, passage, size + 1)[1], minlength=size + 1)
            df[0] += n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "n"])

    rows = table.select("ids").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1, np.int64)
    for r in rows:  # at most a row a term of the block's vocabulary
        df[r["term"]] = r["n"]
    return df, int(df[0])


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.ndim == 1 else np.float32)
    np.cumsum(values, axis=0, out=total[1:])
    return total[stops] - total[starts]


def _unit_rows(passages: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of unit-length TF-IDF passages."""
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    term = np.concatenate(passages).astype(np.int64) if passages else np.zeros(0, np.int64)
    w = idf[term]
    pair, at = np.unique(row * len(idf) + term, return_inverse=True)
    w = np.bincount(at, w, len(pair))
    row, term = pair // len(idf), pair % len(idf)
    norm = np.sqrt(np.bincount(row, w**2, len(passages)))
    return row, term, w / np.maximum(norm[row], 1e-9)


def _gram(rows: tuple[np.ndarray, np.ndarray, np.ndarray], basis: np.ndarray) -> np.ndarray:
    """(A'A) @ basis for sparse A."""
    row, term, w = rows
    out = np.zeros(basis.shape)
    if not len(row):
        return out
    at = np.flatnonzero(np.diff(row, prepend=-1))
    product = np.add.reduceat(basis[term] * w[:, None], at, axis=0)
    which = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(row))))
    for c in range(basis.shape[1]):
        out[:, c] = np.bincount(term, product[which, c] * w, len(out))
    return out


def _stretch_sums(source: np.ndarray, at: np.ndarray, weight: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups, sums of ``source[at]`` by ``weight``) of the stretches of equal ``group``; those of one length are added up at once."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    n = np.diff(first, append=len(group))
    out = np.empty((len(first), source.shape[1]), source.dtype)
    for length in np.unique(n):
        which = np.flatnonzero(n == length)
        words = first[which][:, None] + np.arange(length)
        out[which] = np.matmul(weight[words][:, None, :], source[at[words]])[:, 0]
    return group[first], out


def gram_apply(table: DataFrame, basis: np.ndarray, idf: np.ndarray, queries: Queries, rows: int = 4096) -> tuple[np.ndarray, int]:
    """((A'A) @ basis, rows of A) over all passages of ``table`` that have a term.

    Each task adds up its passages, ``rows`` at a time; its sums are added up by term.
    """
    size, k = basis.shape
    width, dtype = queries.passage, queries.dtype
    basis = basis.astype(np.float32)

    def run(batches):
        total, n = np.zeros((size, k)), 0
        for ids, passage, count in _passages(batches, dtype, width):
            row, term, times = _counts(ids, passage, size)
            w = times * idf[term]
            square = np.bincount(row, w * w, count)
            n += int(np.count_nonzero(square))
            w = (w / np.sqrt(square)[row]).astype(np.float32)
            cuts = np.searchsorted(row, np.arange(0, count + rows, rows))
            for block, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                r, t, v = row[a:z] - block * rows, term[a:z], w[a:z]
                product = np.zeros((rows, k), np.float32)
                at, sums = _stretch_sums(basis, t, v, r)
                product[at] = sums
                order = np.argsort(t.astype(dtype), kind="stable")
                at, sums = _stretch_sums(product, r[order], v[order], t[order])
                total[at] += sums
        total[0, 0] = n  # row 0 stands for no term
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([r.tobytes() for r in total[at].astype("<f4")], pa.binary())], names=["term", "v"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for term, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[term] = total.get(term, 0.0) + np.frombuffer(v.as_buffer(), "<f4").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["term", "v"])

    tasks = max(16, table.sparkSession.sparkContext.defaultParallelism)
    partial = table.select("ids").coalesce(tasks).mapInArrow(run, "term bigint, v binary")
    out = np.zeros((size, k))
    for term, v in partial.repartition(8, "term").mapInArrow(added, "term bigint, v binary").toLocalIterator():  # a row a term
        out[term] = np.frombuffer(v)
    n, out[0] = int(out[0, 0]), 0
    return out, n


def latent_space(table: DataFrame, queries: Queries, idf: np.ndarray, rank: int = 128, extra: int = 8) -> np.ndarray:
    """V: right singular vectors, a row a term, of all corpus and query passages.

    Randomised SVD: (A'A) is applied twice.  The query passages weigh as much in
    all as the corpus passages, so that what tells items apart stays in the space.
    """
    size = len(idf)
    own = _unit_rows([np.array(queries.items[o][1][a:b]) for o, (a, b) in zip(queries.owner, queries.spans, strict=True)], idf)
    k = min(rank + extra, max(1, size - 1))
    basis = np.random.default_rng(11).standard_normal((size, k))
    basis[0] = 0
    y = np.zeros_like(basis)
    for _ in range(2):
        basis = np.linalg.qr(y)[0] if y.any() else basis
        corpus, n = gram_apply(table, basis, idf, queries)
        y = corpus * (len(queries.owner) / max(1, n)) + _gram(own, basis)
    _, u = np.linalg.eigh((basis.T @ y + y.T @ basis) / 2)
    return (basis @ u[:, ::-1])[:, : min(rank, k)]


def _search(table: DataFrame, queries: Queries, v: np.ndarray, idf: np.ndarray, mass: float, cosine: float, projected: float, lcs: float, lcs_answer: float, answer: float, schema: str = SCHEMA, stride: int = 6) -> DataFrame:
    target = _arrow_schema(schema)
    word = (v * idf[:, None]).astype(np.float32)
    square = idf**2
    width, items, owner, dtype, spans = queries.passage, queries.items, queries.owner, queries.dtype, queries.spans
    q = np.stack([word[items[o][1][a:b]].sum(axis=0) for o, (a, b) in zip(owner, spans, strict=True)])
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    exact = Containment(queries, idf, min(lcs, lcs_answer))
    longest = (exact.reach + exact.step - 1).tolist()
    of_item = np.searchsorted(owner, np.arange(len(items) + 1))

    def check(ids: np.ndarray, start: int, j: int) -> tuple | None:
        text, s = items[owner[j]][1], spans[j][0]
        first = max(0, start - s - width // 2)
        last = min(len(ids), start - s + len(text) + width)
        return accept(int(owner[j]), ids, first, last)

    def accept(o: int, ids: np.ndarray, first: int, last: int) -> tuple | None:
        item, text, ans = items[o]
        region = ids[first:last].tolist()
        common = exact.common(o, region, min(lcs, lcs_answer))
        ratio = common / len(text)
        if ratio < min(lcs, lcs_answer) or (len(text) < 3 and ratio < 1):
            return None
        got = lcs_length(ans, region) / len(ans) if ans else 0.0
        if ratio < lcs and got < answer:
            return None
        return item, common, len(text), ratio, got, first, last

    def latent_hits(docs: list[np.ndarray], found: list[dict[int, tuple]]) -> None:
        """Adds to ``found`` (rows by item, a document each) what the latent search finds; the windows of all documents are screened at once."""
        sizes = np.array([len(d) for d in docs], np.int64)
        flat, base = np.concatenate(docs), np.cumsum(sizes) - sizes
        n = np.where(sizes > 0, -(-np.maximum(1, sizes - width + stride) // stride), 0)
        of_doc = np.repeat(np.arange(len(docs)), n)
        starts = base[of_doc] + (np.arange(len(of_doc)) - np.repeat(np.cumsum(n) - n, n)) * stride
        stops = np.minimum(starts + width, (base + sizes)[of_doc])
        on = _sums(square[flat], starts, stops) >= mass
        if not on.any():
            return
        starts, stops, of_doc = starts[on], stops[on], of_doc[on]
        for w0 in range(0, len(starts), 2048):
            a, z, doc = starts[w0 : w0 + 2048], stops[w0 : w0 + 2048], of_doc[w0 : w0 + 2048]
            at = a[:, None] + np.arange(width)[None, :]
            t = np.where(at < z[:, None], flat[np.minimum(at, len(flat) - 1)], 0).astype(np.int64)
            w = word[t].sum(axis=1)
            # length of the whole TF-IDF window, repeated words summed
            t.sort(axis=1)
            new = np.ones(t.shape, bool)
            new[:, 1:] = t[:, 1:] != t[:, :-1]
            run_of = np.cumsum(new.reshape(-1)) - 1
            tf = np.bincount(run_of)
            rows_of = np.repeat(np.arange(len(t)), width)[new.reshape(-1)]
            whole_norm = np.sqrt(np.bincount(rows_of, (tf * idf[t.reshape(-1)[new.reshape(-1)]]) ** 2, len(t)))
            latent = np.linalg.norm(w, axis=1)
            for lo in range(0, len(q), 4096):
                dot = w @ q[lo : lo + 4096].T
                hit = (dot >= cosine * latent[:, None]) & (dot >= projected * whole_norm[:, None]) & (dot > 0)
                for i, j in zip(*np.nonzero(hit), strict=True):
                    d = int(doc[i])
                    best = found[d]
                    row = check(docs[d], int(a[i] - base[d]), int(j) + lo)
                    if row and (row[0] not in best or row[3] > best[row[0]][4]):
                        best[row[0]] = (row[0], float(dot[i, j] / latent[i]), *row[1:])

    def contained(docs: list[np.ndarray], found: list[dict[int, tuple]]) -> None:
        """Adds to ``found`` (a document each) what the exact search finds."""
        for d, o, first in zip(*(x.tolist() for x in exact.regions(docs)), strict=True):
            best = found[d].get(items[o][0])
            if best and best[4] == 1:
                continue
            row = accept(o, docs[d], first, min(len(docs[d]), first + longest[o]))
            if row and (best is None or row[3] > best[4]):
                w = word[docs[d][row[5] : row[6]]].sum(axis=0)
                near = float((q[of_item[o] : of_item[o + 1]] @ w).max() / max(np.linalg.norm(w), 1e-9))
                found[d][row[0]] = (row[0], near, *row[1:])

    def run(batches):
        for b in batches:
            names, texts = b.column(0).to_pylist(), [np.frombuffer(x.as_buffer(), dtype) for x in b.column(1)]
            out: list[tuple] = []
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and held < 200_000:
                    held += len(texts[end])
                    end += 1
                found: list[dict[int, tuple]] = [{} for _ in range(at, end)]
                latent_hits(texts[at:end], found)
                contained(texts[at:end], found)
                out += [(doc, *row) for doc, best in zip(names[at:end], found, strict=True) for row in best.values()]
                at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return bounded(table).select("doc_id", "ids").mapInArrow(run, schema)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    cosine: float = 0.4,
    projected: float = 0.15,
    mass: float = 0.6,
    rank: int = 128,
    lcs: float = 0.6,
    lcs_answer: float = 0.5,
    answer: float = 0.8,
    block_items: int = 5000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
) -> DataFrame:
    """One row a document and benchmark item found in it (columns of ``SCHEMA``)."""
    spark = docs.sparkSession
    schema = SCHEMA.replace("doc_id bigint", "doc_id binary") if docs.schema[id_col].dataType.simpleString() == "binary" else SCHEMA
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("t"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a")).where("t IS NOT NULL")
    out = None
    blocks = max(1, -(-items.count() // block_items))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        queries = Queries(sorted((tuple(r) for r in part.collect()), key=repr))
        if not queries.items:
            continue
        table = materialize(_ids(docs, queries, id_col, text_col))
        df, n = document_frequencies(table, len(queries.vocab), queries.dtype)
        idf = np.log((n + 1) / (df + 1.0)) + 0.1
        idf[0] = 0
        least = mass * min((idf[np.array(queries.items[o][1][a:b])] ** 2).sum() for o, (a, b) in zip(queries.owner, queries.spans, strict=True))
        v = latent_space(table, queries, idf, rank)
        found = _search(table, queries, v, idf, least, cosine, projected, lcs, lcs_answer, answer, schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _ids(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = [queries.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    keyed = docs.schema[id_col].dataType.simpleString() == "binary"
    name = F.col(id_col) if keyed else F.col(id_col).cast("long")
    return bounded(docs).select(name.alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, f"doc_id {'binary' if keyed else 'bigint'}, ids binary")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, whatever their id: they are found by their text."""
    key, bad = fresh(docs, "__key", "__bad")
    text = text_key(options.get("text_col", "text"))
    found = contaminated(docs.withColumn(key, text), benchmark, **{**options, "id_col": key}).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, text == F.col(bad), "left_anti")
