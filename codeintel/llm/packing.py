"""Best-fit packing of tokenized documents into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of bins is open, kept in a bitset
keyed by free space.  A piece goes into the open bin with the least free space
that holds it; if none does, a new bin opens, and where that would be one too
many the fullest open bin closes first.  Only documents longer than a sequence
are cut.

The pieces (a few numbers each, never the ids) are hashed into blocks of a set
number of rows; each block packs alone, in hash order, so order in the input
does no harm and memory is bounded.  A block leaves at most its open bins partly
filled, which is the only loss by splitting.

Edge cases: a null or empty text is its end id alone; rows that repeat are
packed as often as they are there; an empty table packs into nothing; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded, materialize, whole
from .tokens import encoder


class BestFit:
    """Open bins by free space: bit f of ``bits`` is set while a bin with f free is open."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.open, self.next = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return got

    def _put(self, which: int, free: int) -> None:
        if free:
            self.by_free[free].append(which)
            self.bits |= 1 << free
            self.open += 1

    def add(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``size``."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            which = self._take(free)
        else:
            if size < self.capacity and self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, which = self.capacity, self.next
            self.next += 1
        self._put(which, free - size)
        return which, self.capacity - free


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text encoded once and cut at ``capacity``."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    target = _arrow_schema(schema)

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        for b in batches:
            names, done = b.column(0).to_pylist(), 0
            for flat, n in enc.many(b.column(1)):
                rows: list[list] = [[] for _ in range(5)]
                ends = np.cumsum(n)
                flat = np.insert(flat, ends, end).astype("<u4")
                at = 0
                for doc, size in zip(names[done : done + len(n)], (n + 1).tolist(), strict=True):
                    for k, start in enumerate(range(0, size, capacity)):
                        cut = flat[at + start : at + min(start + capacity, size)]
                        for c, v in zip(rows, (doc, k, start, len(cut), zlib.crc32(cut)), strict=True):
                            c.append(v)
                    at += size
                done += len(n)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, target, strict=True)], schema=target)

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 4096, block_rows: int = 1_000_000) -> DataFrame:
    """``pieces`` (with doc_id, piece, length) and where each one lies: sequence_id, offset.

    ``pieces`` is counted first, so give it materialized.
    """
    blocks = max(1, -(-pieces.count() // block_rows))
    cols = pieces.columns
    at = [cols.index(c) for c in ("length",)][0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        fit = BestFit(capacity, open_bins)
        for b in batches:
            got = [fit.add(n) for n in b.column(at).to_pylist()]
            seq, off = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + s for s in seq], pa.int64()), pa.array(off, pa.int64())], names=[*cols, "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece")
    return pieces.repartition(blocks, order).sortWithinPartitions(order, "doc_id", "piece", "length").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, open_bins: int = 4096, block_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col))
    return pack(pieces, capacity, open_bins, block_rows)
