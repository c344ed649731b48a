"""Matroska columns: EBML elements, clusters, lacing and cues as packet tables.

:func:`packet_table` turns a column of Matroska bytes into one row a packet
(frame), with its track, timestamp, cluster, and byte range in the file, so that
media can be sampled or cut without another pass over the container.
:func:`mux_pcm8` stores any bytes losslessly as 8-bit PCM samples in a file with
clusters, laced blocks and cues; :func:`text_media` uses the two for a text
column, and reads everything it returns from the stored bytes.

Read: element ids and sizes of variable length, unknown sizes of segments and
clusters, EBML Void and unknown elements (skipped), SimpleBlock and BlockGroup
(duration, reference), Xiph, EBML and fixed-size lacing, Cues, default durations.

Edge cases: null bytes and bytes that aren't Matroska give no packet and no
error; a file that breaks off gives the packets that are whole; an empty text
has 64 zero samples; equal bytes give equal rows, once for each row of the input.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole

EBML, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TOP = {SEGMENT, EBML, INFO, TRACKS, CLUSTER, CUES, SEEK, TAGS, CHAPTERS, ATTACHMENTS}
PACKETS = "packet int, track int, timestamp_ns bigint, duration_ns bigint, keyframe boolean, cluster int, lacing int, byte_start bigint, byte_end bigint"


# ----- EBML -------------------------------------------------------------------
def read_id(d: bytes, at: int) -> tuple[int, int]:
    """(element id with its length marker, position after it)."""
    n = 9 - d[at].bit_length()
    if n > 4 or at + n > len(d):
        raise ValueError("no element id")
    return int.from_bytes(d[at : at + n], "big"), at + n


def read_size(d: bytes, at: int) -> tuple[int | None, int]:
    """(value of a variable-length number, position after it); None: unknown size."""
    n = 9 - d[at].bit_length()
    if n > 8 or at + n > len(d):
        raise ValueError("no element size")
    v = int.from_bytes(d[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if v == (1 << 7 * n) - 1 else v), at + n


def write_size(v: int, n: int = 0) -> bytes:
    """A variable-length number, in ``n`` bytes or as few as it needs."""
    n = n or next(k for k in range(1, 9) if v < (1 << 7 * k) - 1)
    return (v | 1 << 7 * n).to_bytes(n, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + write_size(len(body)) + body


def number(eid: int, v: int) -> bytes:
    return element(eid, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


def children(d: bytes, at: int, end: int, inside: int = 0):
    """(id, body start, body end) of the elements in d[at:end]; a broken tail ends it.

    An element of unknown size lasts until one that can't lie inside it.
    """
    while at < end:
        try:
            eid, p = read_id(d, at)
            n, p = read_size(d, p)
        except (ValueError, IndexError):
            return
        if inside == CLUSTER and eid in TOP:
            return
        if n is None:
            stop = end
            if eid == CLUSTER:
                stop = p
                for _, _, stop in children(d, p, end, CLUSTER):  # noqa: B007
                    pass
            yield eid, p, stop
            at = stop
            continue
        if p + n > end and eid not in CONTAINERS:
            return  # the file breaks off in it
        yield eid, p, min(p + n, end)
        at = p + n


#: Elements whose whole children count even where the file breaks off in them.
CONTAINERS = {SEGMENT, CLUSTER, INFO, TRACKS, CUES}


def _uint(d: bytes, a: int, b: int) -> int:
    return int.from_bytes(d[a:b], "big")


# ----- blocks -----------------------------------------------------------------
def unlace(d: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; ``at`` is just after the block's flags."""
    if not lacing:
        return [(at, end)]
    n = d[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("fixed lacing doesn't divide")
        sizes = [(end - at) // n] * n
    elif lacing == 1:
        for _ in range(n - 1):
            s = 0
            while d[at] == 255:
                s, at = s + 255, at + 1
            sizes.append(s + d[at])
            at += 1
    else:
        for k in range(n - 1):
            length = 9 - d[at].bit_length()
            v, at = read_size(d, at)
            v = (1 << 7 * length) - 1 if v is None else v
            sizes.append(v if not k else sizes[-1] + v - ((1 << 7 * length - 1) - 1))
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("lace sizes don't fit")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The body of a laced block: 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == 3:
        head += write_size(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            n = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
            head += write_size(b - a + (1 << 7 * n - 1) - 1, n)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs equal frames")
    return head + b"".join(frames)


def parse(d: bytes | None) -> dict:
    """Tracks, cues and packets of a file.

    packets: (packet, track, timestamp_ns, duration_ns, keyframe, cluster, lacing,
    byte_start, byte_end), in file order; cues: (time_ns, track, cluster's byte
    position in the file); tracks: {number: {codec, kind, rate, channels, depth, frame_ns}}.
    """
    out: dict = {"tracks": {}, "cues": [], "packets": [], "clusters": [], "scale": 1_000_000, "duration": None}
    if not d or d[:4] != b"\x1a\x45\xdf\xa3":
        return out
    for eid, a, b in children(d, 0, len(d)):
        if eid != SEGMENT:
            continue
        for e2, a2, b2 in children(d, a, b, SEGMENT):
            if e2 == INFO:
                for e3, a3, b3 in children(d, a2, b2):
                    if e3 == SCALE:
                        out["scale"] = _uint(d, a3, b3)
                    elif e3 == DURATION and b3 - a3 in (4, 8):
                        out["duration"] = float(np.frombuffer(d[a3:b3], f">f{b3 - a3}")[0])
            elif e2 == TRACKS:
                _tracks(d, a2, b2, out)
            elif e2 == CLUSTER:
                _cluster(d, a2, b2, out)
            elif e2 == CUES:
                for e3, a3, b3 in children(d, a2, b2):
                    if e3 == POINT:
                        time = 0
                        for e4, a4, b4 in children(d, a3, b3):
                            if e4 == CUE_TIME:
                                time = _uint(d, a4, b4)
                            elif e4 == POSITIONS:
                                at = {e5: _uint(d, a5, b5) for e5, a5, b5 in children(d, a4, b4)}
                                out["cues"].append((time * out["scale"], at.get(CUE_TRACK, 0), a + at.get(CUE_CLUSTER, 0)))
    return out


def _tracks(d: bytes, a: int, b: int, out: dict) -> None:
    for eid, p, q in children(d, a, b):
        if eid != ENTRY:
            continue
        t: dict = {"codec": None, "kind": None, "rate": None, "channels": None, "depth": None, "frame_ns": None}
        n = None
        for e, x, y in children(d, p, q):
            if e == NUMBER:
                n = _uint(d, x, y)
            elif e == CODEC:
                t["codec"] = d[x:y].decode("ascii", "replace")
            elif e == KIND:
                t["kind"] = _uint(d, x, y)
            elif e == DEFAULT_DURATION:
                t["frame_ns"] = _uint(d, x, y)
            elif e == AUDIO:
                for e2, x2, y2 in children(d, x, y):
                    if e2 == RATE and y2 - x2 in (4, 8):
                        t["rate"] = float(np.frombuffer(d[x2:y2], f">f{y2 - x2}")[0])
                    elif e2 == CHANNELS:
                        t["channels"] = _uint(d, x2, y2)
                    elif e2 == DEPTH:
                        t["depth"] = _uint(d, x2, y2)
        if n is not None:
            out["tracks"][n] = t


def _cluster(d: bytes, a: int, b: int, out: dict) -> None:
    base, which = 0, len(out["clusters"])
    out["clusters"].append((a, b))
    for eid, p, q in children(d, a, b, CLUSTER):
        if eid == TIME:
            base = _uint(d, p, q)
        elif eid == SIMPLE:
            _block(d, p, q, base, which, None, None, out)
        elif eid == GROUP:
            block, duration, key = None, None, True
            for e, x, y in children(d, p, q):
                if e == BLOCK:
                    block = (x, y)
                elif e == BLOCK_DURATION:
                    duration = _uint(d, x, y)
                elif e == REFERENCE:
                    key = False
            if block:
                _block(d, *block, base, which, key, duration, out)


def _block(d: bytes, p: int, q: int, base: int, which: int, key: bool | None, duration: int | None, out: dict) -> None:
    try:
        track, p = read_size(d, p)
        time = base + int.from_bytes(d[p : p + 2], "big", signed=True)
        flags = d[p + 2]
        frames = unlace(d, p + 3, q, flags >> 1 & 3)
    except (ValueError, IndexError, TypeError):
        return  # a block that breaks off
    scale = out["scale"]
    step = (out["tracks"].get(track) or {}).get("frame_ns") or (duration * scale // len(frames) if duration else None)
    for k, (x, y) in enumerate(frames):
        at = time * scale + (k * step if step else 0)
        out["packets"].append((len(out["packets"]), track, at, step, bool(flags & 0x80) if key is None else key, which, flags >> 1 & 3, x, y))


# ----- writing 8-bit PCM ------------------------------------------------------
def mux_pcm8(samples: bytes, rate: int = 8000, frame: int = 512, per_block: int = 8, blocks: int = 16) -> bytes:
    """A Matroska file with one 8-bit PCM track holding ``samples``, losslessly.

    Full blocks have fixed-size lacing, a last one of uneven frames EBML lacing
    (or none, for one frame).  A cluster has ``blocks`` blocks and a cue.
    """
    frame_ns = frame * 10**9 // rate
    entry = number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, frame_ns)
    entry += element(AUDIO, element(RATE, np.array(rate, ">f8").tobytes()) + number(CHANNELS, 1) + number(DEPTH, 8))
    duration = len(samples) * 1000 / rate
    head = element(INFO, number(SCALE, 1_000_000) + element(DURATION, np.array(duration, ">f8").tobytes())) + element(TRACKS, element(ENTRY, entry))
    body, cues, at = [head], [], len(head)
    step = frame * per_block
    for c in range(0, len(samples), step * blocks):
        ms = c * 1000 // rate
        parts = [number(TIME, ms)]
        for b in range(c, min(c + step * blocks, len(samples)), step):
            cut = samples[b : b + step]
            frames = [cut[k : k + frame] for k in range(0, len(cut), frame)]
            lacing = 0 if len(frames) == 1 else 2 if len(cut) % frame == 0 else 3
            rel = b * 1000 // rate - ms
            parts.append(element(SIMPLE, b"\x81" + rel.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1]) + lace(frames, lacing)))
        cues.append(element(POINT, number(CUE_TIME, ms) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    ebml = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    return ebml + element(SEGMENT, b"".join(body))


def demux(d: bytes, track: int = 1) -> tuple[dict, bytes]:
    """(parsed file, the track's frames joined)."""
    p = parse(d)
    return p, b"".join([d[r[7] : r[8]] for r in p["packets"] if r[1] == track])


# ----- Spark ------------------------------------------------------------------
def packet_table(media: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """One row a packet of each file: the id and the columns of ``PACKETS``."""
    kind = media.select(id_col).schema[0].dataType.simpleString()

    def run(ids, blobs):
        for i, d in zip(ids, blobs, strict=True):
            for row in parse(d)["packets"]:
                yield (i, *row)

    return map_rows(media.select(id_col, bytes_col), run, f"`{id_col}` {kind}, {PACKETS}")


def cue_table(media: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """One row a cue: the id, time_ns, track, cluster's byte position."""
    kind = media.select(id_col).schema[0].dataType.simpleString()

    def run(ids, blobs):
        for i, d in zip(ids, blobs, strict=True):
            for row in parse(d)["cues"]:
                yield (i, *row)

    return map_rows(media.select(id_col, bytes_col), run, f"`{id_col}` {kind}, time_ns bigint, track int, cluster_start bigint")


def padded(text: str) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each whole text as a Matroska file, and what its packets hold.

    The feature counts clusters, cues that meet a cluster, packets and laced
    packets, and gives the time span and the mean, deviation, zero crossings and
    peak of the samples.
    """
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    schema += ", media binary" if keep_media else ""

    def run(ids, texts):
        for i, text in zip(ids, texts, strict=True):
            payload = padded(text)
            media = mux_pcm8(payload)
            p, back = demux(media)
            x = np.frombuffer(back, np.uint8)
            signed = x.astype(np.int16) - 128
            hits = sum(media[c : c + 4] == b"\x1f\x43\xb6\x75" for _, _, c in p["cues"])
            last = p["packets"][-1]
            feature = f"clusters={len(p['clusters'])};cues={hits};packets={len(p['packets'])};laced={sum(r[6] > 0 for r in p['packets'])};last_ns={last[2]};mean={x.mean():.6f};std={x.std():.6f};crossings={int(np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0)))};peak={int(np.abs(signed).max())}"
            n = len(text.encode("utf-8", "surrogatepass"))
            row = (i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
            yield (*row, media) if keep_media else row

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")), run, schema, rows=200 if keep_media else 4000)
