"""Near-duplicate classes: one-permutation MinHash, stars, exact confirmation.

A document's set holds its distinct five-word shingles as 64-bit hashes.

1. *One permutation.*  The top bits of a shingle's hash choose a bin, the least
   hash in a bin is its minimum: one hash a shingle, whatever the signature
   length.  Empty bins borrow from a bin drawn by a hash of (bin, attempt), the
   optimal densification, so two sets borrow alike.
2. *Exact copies* collapse first: documents are grouped by a 128-bit hash of the
   set, and only the least doc_id of each class goes on.
3. *Banded buckets.*  42 bands of 6 minima; every member of a bucket has one edge,
   to the bucket's least doc_id.  A bucket of n members gives n - 1 edges, never
   n * n.  The components of these star edges are candidate groups: a superset of
   the linked pairs, as both ends of any pair in a bucket hang on one centre.
4. *Confirmation* on full sets, within groups: exact intersections of all members,
   as products of 0/1 matrices over blocks of bounded size.  No pair leaves a
   task, only a spanning forest of the confirmed links.  Groups over a block are
   split by hash: each block meets itself and a few hubs that all blocks share,
   and then only members outside a group's largest class meet all blocks.
5. The components of the confirmed links are the classes.

A pair at similarity 0.85 shares no band with probability (1 - 0.85^6)^42 =
2e-9, less the more alike it is; all else is exact.

Edge cases: null and empty texts and texts of white space have an empty set and
are linked with nothing; fewer than five words are one shingle; equal sets are
linked; rows that repeat (equal doc_id) are one vertex and each returned; rows
with a null doc_id are returned with a null component, kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded, discard, fresh, materialize, whole
from .components import components

BINS, ROWS, BANDS = 256, 6, 42
BLOCK_ROWS, BLOCK_BYTES, HUBS = 1024, 16 << 20, 8
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_PROBE = _RNG.integers(0, BINS, (96, BINS))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Ascending distinct hashes of the shingles of a whole text.

    Words are runs without ASCII white space, A-Z lowered: just what ``bytes``
    does in ``lower`` and ``split``.
    """
    from xxhash import xxh3_64_digest

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return _mix(np.frombuffer(xxh3_64_digest(b"short " + b" ".join(w)), "<u8").astype(np.uint64))
    h = np.frombuffer(b"".join(map(xxh3_64_digest, w)), "<u8").astype(np.uint64)
    n = len(h) - words + 1
    s = h[:n] * _ODD[0]
    for k in range(1, words):
        s = s + h[k : k + n] * _ODD[k]
    return np.unique(_mix(s))


def signature(u: np.ndarray) -> np.ndarray:
    """One minimum a bin of a non-empty set, empty bins densified."""
    bins = (u >> np.uint64(56)).astype(np.int64)
    at = np.flatnonzero(np.diff(bins, prepend=-1))
    sig, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[bins[at]], full[bins[at]] = u[at], True
    if len(at) < BINS:
        empty = np.flatnonzero(~full)
        for probe in _PROBE:
            to = probe[empty]
            hit = full[to]
            sig[empty[hit]] = sig[to[hit]]
            empty = empty[~hit]
            if not len(empty):
                break
        else:  # very few full bins: the next full one
            known = np.flatnonzero(full)
            sig[empty] = sig[known[np.searchsorted(known, empty) % len(known)]]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """A bucket key for each band, the band's number mixed in."""
    s = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    return _mix((s * _ODD[8 : 8 + ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[20]).view(np.int64)


def links(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = 85) -> np.ndarray:
    """Boolean matrix: which pairs have 100 * |A & B| >= percent * |A | B|.  Exact.

    ``side`` (0/1): only pairs across sides, or with side 2, count.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        inter = np.array([[size[0], both], [both, size[1]]])
    else:
        owner = np.repeat(np.arange(n), size)
        flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
        _, term, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        new = np.cumsum(shared) - 1
        on = shared[term]
        term, owner = new[term[on]], owner[on]
        order = np.argsort(term, kind="stable")
        term, owner = term[order], owner[order]
        inter = np.zeros((n, n), np.float32)  # whole numbers below 2**24
        step = 8192
        for lo in range(0, int(new[-1]) + 1 if len(new) else 0, step):
            a, b = np.searchsorted(term, [lo, lo + step])
            m = np.zeros((n, step), np.float32)
            m[owner[a:b], term[a:b] - lo] = 1
            inter += m @ m.T
        inter = np.rint(inter).astype(np.int64)
        np.fill_diagonal(inter, size)
    union = size[:, None] + size[None, :] - inter
    out = (100 * inter >= percent * union) & (union > 0)
    if side is not None:
        out &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    return out


def forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """(member, least member) for each linked class: a spanning star."""
    n = len(ids)
    done = np.zeros(n, bool)
    out = []
    for i in np.argsort(ids, kind="stable"):
        if done[i]:
            continue
        seen = np.zeros(n, bool)
        seen[i] = True
        front = seen.copy()
        while front.any():
            nxt = linked[front].any(axis=0) & ~seen
            seen |= nxt
            front = nxt
        done |= seen
        out += [(int(x), int(ids[i])) for x in ids[seen] if x != ids[i]]
    return out


# ----- Spark ------------------------------------------------------------------
def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = "doc_id bigint, n_shingles bigint, n_bytes bigint, key binary, bands array<bigint>"
    target = _arrow_schema(schema)

    def run(batches):
        for b in batches:
            n, size, key, flat = [], [], [], []
            offsets = [0]
            for t in b.column(1).to_pylist():
                u = shingle_set(t)
                n.append(len(u)), size.append(len(t))
                key.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                if len(u):
                    flat.append(bands(signature(u)))
                offsets.append(offsets[-1] + (BANDS if len(u) else 0))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(target.field("bands").type)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(key, pa.binary()), lists], schema=target)

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, schema)


def _confirm(rows: DataFrame, percent: int) -> DataFrame:
    """Confirmed edges (a, b) of rows (task, side, id, text): a spanning forest a task."""
    target = _arrow_schema("a bigint, b bigint")

    def run(batches):
        def close():
            if len(ids) < 2:
                return []
            keep = sorted(range(len(ids)), key=lambda k: (ids[k], sides[k]))
            s = np.array([sides[k] for k in keep])
            return forest(np.array([ids[k] for k in keep]), links([shingle_set(texts[k]) for k in keep], s, percent))

        task, ids, sides, texts, out = None, [], [], [], []
        for b in batches:
            for t, s, i, x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if t != task:
                    out += close()
                    task, ids, sides, texts = t, [], [], []
                ids.append(i), sides.append(s), texts.append(x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=target)
                out = []
        out += close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=target)

    return rows.select("task", "side", "id", "text").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a bigint, b bigint")


def _task(*parts) -> F.Column:
    return F.concat_ws("/", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    from pyspark.sql import Window

    sigs = materialize(_signatures(docs, id_col, text_col))
    known = sigs.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("key").agg(F.min(F.struct("doc_id", "n_bytes", "bands")).alias("c")).select("key", F.col("c.doc_id").alias("id"), F.col("c.n_bytes").alias("n_bytes"), F.col("c.bands").alias("bands"))
    # The least member of a bucket is found with map-side combining, and joined
    # back only where the bucket has others: a hot bucket is one row on that side,
    # and adaptive execution splits the other.
    placed_in = classes.select("id", F.explode("bands").alias("bucket"))
    centres = placed_in.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre <> last").select("bucket", "centre")
    star = placed_in.join(centres, "bucket").where("id <> centre")
    joined = components(star.select(F.col("id").alias("a"), F.col("centre").alias("b")))
    groups = materialize(joined)
    discard(joined)

    # Sizes of the groups decide their blocks.
    weight = known.groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes"))
    members = materialize(groups.join(weight, groups["node"] == weight["doc_id"]).select(F.col("node").alias("id"), F.col("component").alias("gid"), "n_bytes"))
    sizes = members.groupBy("gid").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias("blocks"), F.count("*").alias("m"))
    big = {"n": sizes.where("blocks > 1").count()}
    text = docs.select(F.col(id_col).cast("long").alias("did"), whole(text_col).alias("text"))
    placed = members.join(sizes, "gid").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    if not big["n"]:
        with_text = placed.join(text, F.col("id") == F.col("did"))
        edges = materialize(_confirm(with_text.select(_task("gid").alias("task"), F.lit(2).alias("side"), "id", "text"), percent))
    else:
        # A few hubs of each large group meet every block, the other members their own.
        rank = Window.partitionBy("gid", "block").orderBy(F.xxhash64("id", F.lit(1)), "id")
        hub = placed.where("blocks > 1").withColumn("r", F.row_number().over(rank)).where((F.col("r") <= HUBS) & (F.col("block") < HUBS)).groupBy("gid").agg(F.slice(F.sort_array(F.collect_list(F.struct("r", "block", "id"))), 1, HUBS).alias("h"))
        hubs = hub.select("gid", F.explode("h.id").alias("id")).withColumn("is_hub", F.lit(True))
        with_text = materialize(placed.join(hubs, ["gid", "id"], "left").join(text, F.col("id") == F.col("did")).select("gid", "id", "block", "blocks", "m", F.coalesce("is_hub", F.lit(False)).alias("is_hub"), "text"))
        own = with_text.where("NOT is_hub").select(_task("gid", "block").alias("task"), F.lit(2).alias("side"), "id", "text")
        sent = with_text.where("is_hub").select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), "gid", "id", "text").select(_task("gid", "to").alias("task"), F.lit(2).alias("side"), "id", "text")
        once = materialize(_confirm(own.unionByName(sent), percent))
        part = components(once)
        at = with_text.where("blocks > 1").select("gid", "id", "block", "blocks").join(part, F.col("id") == F.col("node"), "left").withColumn("class", F.coalesce("component", "id"))
        count = at.groupBy("gid", "class").count()
        largest = count.groupBy("gid").agg(F.max(F.struct("count", "class")).alias("l")).select("gid", F.col("l.class").alias("largest"))
        rest = rest_table = materialize(at.join(largest, "gid").where("class <> largest").select("gid", "id", "class"))
        # Members outside the largest class meet every block once.
        n_rest = rest.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("slots"))
        rest = rest.join(n_rest, "gid").withColumn("slot", F.pmod(F.xxhash64("id", F.lit(2)), F.col("slots")).cast("int"))
        texts = with_text.select("gid", "id", "block", "blocks", "text")
        left = rest.join(texts, ["gid", "id"]).select("gid", "id", "slot", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = texts.where("blocks > 1").join(n_rest, "gid").select("gid", "id", "block", "text", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
        cross = left.select(_task("gid", "slot", "block").alias("task"), F.lit(0).alias("side"), "id", "text").unionByName(right.select(_task("gid", "slot", "block").alias("task"), F.lit(1).alias("side"), "id", "text"))
        edges = materialize(once.unionByName(_confirm(cross, percent)))
        discard(with_text, rest_table, once, part)

    linked = components(edges)
    discard(edges, members, groups)
    named = classes.select("key", "id").join(linked, F.col("id") == F.col("node"), "left").select("key", F.coalesce("component", "id").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the least doc_id.

    Repeated rows of that id leave one; rows with a null id all stay.
    """
    from pyspark.sql import Window

    found = materialize(near_duplicates(docs, percent, id_col, text_col).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    lost, nth = fresh(docs, "__gone", "__n")
    gone = found.where("NOT kept").select(F.col("doc_id").alias(lost))
    out = docs.join(gone, F.col(id_col) == F.col(lost), "left_anti")
    if found.where("kept AND n > 1").limit(1).count():
        one = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
        out = out.withColumn(nth, F.row_number().over(one)).where((F.col(nth) == 1) | F.col(id_col).isNull()).drop(nth)
    return out
