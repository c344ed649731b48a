"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Format of one file ``part-NNNNN.svb`` (little-endian)::

    magic 8 bytes | n_docs u8 | n_control u8 | n_data u8
    doc_id i8[n_docs] | null flag u1[n_docs] | n_tokens u4[n_docs]
    control bytes of all documents | data bytes of all documents

An id is replaced by its rank in the corpus (0: the most frequent), written in
as few whole bytes as it needs.  The lengths are apart from the data, in control
bytes: eight lengths of 1-2 bytes each (vocabularies up to 65,536), or four of
1-4 bytes.  A document starts on a control byte of its own.  Decoding looks the
control bytes up in a table of lengths and gathers: no loop over tokens.
``ranks.npy`` beside the parts maps ranks back to ids.

A file has at most ``file_tokens`` ids (or one document), whatever the corpus,
and is coded and read in slices of half a million, so memory has a bound.

Edge cases: a null text is empty and has the end id only; a null id is kept
(flag); repeated rows are all written, in an arbitrary but fixed order among
equal ids; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded, materialize, parts, shared_dir, whole
from .tokens import encoder, release

MAGIC = b"SVBRANK1"
SLICE = 1 << 19  # ids coded at once: a multiple of the lengths in a control byte


# ----- the code ---------------------------------------------------------------
def code_bits(vocab: int) -> int:
    """Bits of a length code: 1 for vocabularies up to 65,536, else 2."""
    return 1 if vocab <= 65536 else 2


def _length_table(bits: int) -> np.ndarray:
    n = 8 // bits
    codes = (np.arange(256)[:, None] >> (bits * np.arange(n))[None, :]) & ((1 << bits) - 1)
    return (codes + 1).astype(np.uint8)


def svb_encode_many(values: np.ndarray, counts: np.ndarray, bits: int) -> tuple[bytes, np.ndarray, bytes, np.ndarray]:
    """(control, its ends, data, its ends) of many runs of values laid end to end."""
    v = values.astype("<u4")
    per = 8 // bits
    size = 1 + (v > 0xFF).astype(np.uint8)
    if bits == 2:
        size += (v > 0xFFFF).astype(np.uint8) + (v > 0xFFFFFF).astype(np.uint8)
    groups = -(-counts // per)
    ends = np.cumsum(groups)
    code = np.zeros(int(ends[-1]) * per if len(ends) else 0, np.uint8)
    at = np.arange(len(v)) + np.repeat((ends - groups) * per - (np.cumsum(counts) - counts), counts)
    code[at] = size - 1
    if bits == 1:
        control = np.packbits(code, bitorder="little")
    else:
        control = (code.reshape(-1, per) << (bits * np.arange(per, dtype=np.uint8))).sum(axis=1, dtype=np.uint8)
    width = int(size.max()) if len(v) else 1
    data = v.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width)[None, :] < size[:, None]]
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return control.tobytes(), ends, data.tobytes(), total[np.cumsum(counts)]


def svb_encode(values: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned values."""
    control, _, data, _ = svb_encode_many(values, np.array([len(values)]), bits)
    return control, data


def svb_decode(control: bytes, data: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` values of :func:`svb_encode`, by table lookup."""
    size = _length_table(bits)[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    return _gather(np.frombuffer(data, np.uint8), size)


def _gather(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size, dtype=np.int64) - size
    out = raw[at].astype(np.uint32) if len(size) else np.zeros(0, np.uint32)
    for k in range(1, int(size.max()) if len(size) else 0):
        has = np.flatnonzero(size > k)
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _cells(data: bytes, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _flat(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column end to end, and how many each row has."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]].view(dtype), np.diff(at) // np.dtype(dtype).itemsize


# ----- files ------------------------------------------------------------------
def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(uri: str, blocks: list[bytes]) -> None:
    """Written under another name, then moved: a second attempt is harmless."""
    import uuid

    fs, path = _fs(uri)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        for b in blocks:
            f.write(b)
    fs.move(tmp, path)


def _read(uri: str) -> bytes:
    fs, path = _fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def read_file(blob: bytes, ranks: np.ndarray, bits: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of one file."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    n, n_control, n_data = np.frombuffer(blob, "<u8", 3, 8).tolist()
    at = 32
    ids = np.frombuffer(blob, "<i8", n, at)
    null = np.frombuffer(blob, np.uint8, n, at + 8 * n)
    count = np.frombuffer(blob, "<u4", n, at + 9 * n).astype(np.int64)
    at += 13 * n
    per = 8 // bits
    table = _length_table(bits)
    groups = -(-count // per)
    raw = np.frombuffer(blob, np.uint8)
    c_at, d_at, i = at, at + n_control, 0
    while i < n:
        # as many documents as make about a million tokens
        j = max(i + 1, int(np.searchsorted(np.cumsum(count[i:]), 1_000_000, "right")) + i)
        g, c = groups[i:j], count[i:j]
        size = table[raw[c_at : c_at + int(g.sum())]].reshape(-1)
        real = np.arange(int(c.sum())) + np.repeat((np.cumsum(g) - g) * per - (np.cumsum(c) - c), c)
        size = size[real]
        values = ranks[_gather(raw[d_at : d_at + int(size.sum(dtype=np.int64))], size)]
        ends = np.cumsum(c).tolist()
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            yield (None if null[i + k] else int(ids[i + k])), values[a:b]
        c_at, d_at, i = c_at + int(g.sum()), d_at + int(size.sum(dtype=np.int64)), j
    if d_at != at + n_control + n_data:
        raise ValueError("token file is damaged")


# ----- Spark ------------------------------------------------------------------
def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text encoded once, little-endian ids as binary."""

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        for b in batches:
            at = 0
            for flat, n in enc.many(b.column(1)):
                ids = np.insert(flat, np.cumsum(n), end)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), _cells(ids.tobytes(), np.cumsum(n + 1) * enc.dtype.itemsize)], names=["doc_id", "ids"])
                at += len(n)

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids binary")


def frequency_ranks(tokens: DataFrame, vocab: int, dtype: str) -> np.ndarray:
    """ids by falling corpus frequency, ties by id: the rank table.

    Each partition counts by ``bincount``; what reaches the driver has at most
    one row an id of the vocabulary, whatever the corpus.
    """

    def count(batches):
        release()
        total = np.zeros(vocab, np.int64)
        for b in batches:
            total += np.bincount(_flat(b.column(0), dtype)[0], minlength=vocab)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    freq = np.zeros(vocab, np.int64)
    for r in rows:
        freq[r["id"]] = r["n"]
    return np.lexsort((np.arange(vocab), -freq)).astype(np.uint32)


def _slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents with at most ``most`` ids, or one document."""
    ends, i = np.cumsum(counts), 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


class _File:
    """Coded documents that wait to be one file."""

    def __init__(self):
        self.ids, self.null, self.count, self.control, self.data, self.tokens = [], [], [], [], [], 0

    def add(self, docs: pa.Array, ranks: np.ndarray, counts: np.ndarray, bits: int) -> None:
        self.ids.append(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.null.append(docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.count.append(counts.astype("<u4"))
        for at in range(0, max(1, len(ranks)), SLICE) if len(counts) == 1 else (0,):
            cut = ranks[at : at + SLICE] if len(counts) == 1 else ranks
            control, _, data, _ = svb_encode_many(cut, np.array([len(cut)]) if len(counts) == 1 else counts, bits)
            self.control.append(control), self.data.append(data)
        self.tokens += len(ranks)

    def blocks(self) -> list[bytes]:
        sizes = [sum(map(len, x)) for x in (self.ids, self.control, self.data)]
        head = [MAGIC, np.array(sizes, "<u8").tobytes()]
        return [*head, *(x.tobytes() for col in (self.ids, self.null, self.count) for x in col), *self.control, *self.data]

    def __len__(self) -> int:
        return sum(map(len, self.ids))


MANIFEST = "part int, file int, path string, n_docs bigint, n_tokens bigint"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 1 << 25) -> DataFrame:
    """Write the files in ascending id order; return their manifest.

    Columns: part, file, path, n_docs, n_tokens, base (ids in all files before it).
    The texts are encoded once; ranks need the whole corpus's counts, so the ids
    wait in a scratch table.  One range shuffle of it orders them, and the files
    are coded where the ordered ids arrive.
    """
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    vocab, dtype = max(enc.tok.get_vocab_size(), end_id + 1), enc.dtype.str
    bits = code_bits(vocab)
    out = out or shared_dir(spark)
    tokens = materialize(token_table(docs, tokenizer, end_id, id_col, text_col))
    ranks = frequency_ranks(tokens, vocab, dtype)
    fs, path = _fs(out)
    fs.create_dir(path, recursive=True)
    _write(f"{out}/ranks.npy", [ranks.tobytes()])
    rank_of = np.empty(vocab, np.uint32)
    rank_of[ranks] = np.arange(vocab, dtype=np.uint32)
    target = _arrow_schema(MANIFEST)

    def save(batches):
        from pyspark import TaskContext

        release()
        part, number, held = TaskContext.get().partitionId(), 0, _File()

        def close():
            nonlocal number, held
            _write(name := f"{out}/part-{part:05d}-{number:05d}.svb", held.blocks())
            row = pa.RecordBatch.from_pylist([{"part": part, "file": number, "path": name, "n_docs": len(held), "n_tokens": held.tokens}], schema=target)
            number, held = number + 1, _File()
            return row

        for b in batches:
            values, n = _flat(b.column(1), dtype)
            at = 0
            for i, j in _slices(n, min(SLICE, file_tokens)):
                size = int(n[i:j].sum())
                if held.tokens and held.tokens + size > file_tokens:
                    yield close()
                held.add(b.column(0).slice(i, j - i), rank_of[values[at : at + size]], n[i:j], bits)
                at += size
        if len(held):
            yield close()

    ordered = bounded(tokens).repartitionByRange(parts(spark), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    files = ordered.mapInArrow(save, MANIFEST).collect()  # one row a file
    base, rows = 0, []
    for f in sorted(files):
        rows.append((*f, base))
        base += f["n_tokens"]
    return spark.createDataFrame(rows, MANIFEST + ", base bigint")


def read_token_files(spark: SparkSession, manifest: DataFrame, bits: int, with_ids: bool = False) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    target = _arrow_schema(schema)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    def run(batches):
        release()
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ranks = np.frombuffer(_read(path.rsplit("/", 1)[0] + "/ranks.npy"), np.uint32)
                rows, at, held = [], base, 0
                for doc, ids in read_file(_read(path), ranks, bits):
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int32)] if with_ids else [])))
                    at += len(ids)
                    held += len(ids)
                    if held > SLICE:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, min(parts(spark) * 2, manifest.count()))
    return manifest.select("path", "base").repartition(n, "path").mapInArrow(run, schema)


def token_id_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files of ``docs`` and return what is read back from them."""
    manifest = write_token_files(docs, tokenizer, end_id)
    vocab = max(encoder(tokenizer).tok.get_vocab_size(), end_id + 1)
    return read_token_files(docs.sparkSession, manifest, code_bits(vocab))
