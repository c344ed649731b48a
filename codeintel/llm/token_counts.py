"""Token counts by section: one encoding a document, spans joined to intervals.

Every document is encoded once, whole.  Its tokens' character spans are joined
to its sections by binary search on the section starts, beside the document, so
nothing is shuffled.  A token whose characters lie in more than one section is
given by an explicit rule:

``majority`` (default)  to the section with most of its characters; ties to the
                        earlier section
``start``               to the section that holds its first character
``end``                 to the section that holds its last character
``fraction``            to each section, by its share of the token's characters

Characters in no section are section -1, so the counts of a document always add
up to its number of tokens.  Several byte tokens of one character each span that
character, and each counts once.

Edge cases: a null or empty text has one row, section -1, with no tokens; null,
empty or reversed sections take nothing; sections are ordered by start, and
where they overlap the later start wins; rows that repeat are each counted; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded, whole
from .tokens import encoder

RULES = ("majority", "start", "end", "fraction")


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens) of each section; the last is section -1.

    ``starts`` must ascend.  A section ends where the next one starts, at latest.
    """
    k = len(starts)
    out, cross = np.zeros(k + 1), np.zeros(k + 1)
    if not len(spans):
        return out, cross
    if k:
        ends = np.minimum(ends, np.append(starts[1:], np.iinfo(np.int64).max))
        ends = np.maximum(ends, starts)

    def at(pos: np.ndarray) -> np.ndarray:
        if not k:
            return np.full(len(pos), -1)
        i = np.searchsorted(starts, pos, "right") - 1
        return np.where((i >= 0) & (pos < ends[np.maximum(i, 0)]), i, -1)

    s, e = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    a, b = at(s), at(e - 1)
    lo = np.searchsorted(starts, s, "right") if k else np.zeros(len(s), int)
    hi = np.searchsorted(starts, e - 1, "right") if k else np.zeros(len(s), int)
    whole_in = (a == b) & (lo == hi)
    np.add.at(out, np.where(a < 0, k, a)[whole_in], 1)
    for j in np.flatnonzero(~whole_in):
        share: dict[int, int] = {}
        for x in at(np.arange(s[j], e[j])).tolist():
            share[x] = share.get(x, 0) + 1
        if rule == "start":
            to = {int(a[j]): 1.0}
        elif rule == "end":
            to = {int(b[j]): 1.0}
        elif rule == "fraction":
            to = {x: n / int(e[j] - s[j]) for x, n in share.items()}
        else:
            most = max(share.values())
            to = {min((x for x, n in share.items() if n == most), key=lambda x: (x < 0, x)): 1.0}
        for x, n in to.items():
            out[x if x >= 0 else k] += n
        for x in share:
            cross[x if x >= 0 else k] += 1
    return out, cross


def _lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the lines that aren't empty, without their line feeds."""
    n = np.array([len(x) for x in text.split("\n")], np.int64)
    stop = np.cumsum(n + 1) - 1
    keep = n > 0
    return (stop - n)[keep], stop[keep]


def count_tokens(docs: DataFrame, tokenizer: str, sections: str | None = None, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", split: Callable = _lines) -> DataFrame:
    """Per document and section: doc_id, section, start, stop, n_tokens, n_crossing.

    ``sections`` names a column of array<struct<start, stop>> (code points, end
    exclusive); without it, ``split`` makes them from the text (its lines).
    ``n_tokens`` is a double, whole but for the rule ``fraction``.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = "doc_id bigint, section int, start bigint, stop bigint, n_tokens double, n_crossing bigint"
    target = _arrow_schema(schema)
    cols = [F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")]
    if sections:
        cols.append(F.transform(F.col(sections), lambda x: F.struct(x["start"].cast("long").alias("start"), x["stop"].cast("long").alias("stop"))).alias("sections"))

    def run(batches):
        enc = encoder(tokenizer, spans=True)
        for b in batches:
            given = b.column(2).to_pylist() if sections else None
            rows: list[list] = [[] for _ in range(6)]
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if given is None:
                    starts, stops = split(text)
                else:
                    known = sorted((x["start"], x["stop"]) for x in given[i] or [] if x and None not in x.values() and x["start"] < x["stop"])
                    starts, stops = np.array([x[0] for x in known], np.int64), np.array([x[1] for x in known], np.int64)
                _, spans = enc.ids_and_spans(text)
                n, cross = attribute(spans, starts, stops, rule)
                k = len(starts)
                outside = n[k] > 0 or cross[k] > 0 or k == 0
                m = k + int(outside)
                rows[0] += [doc] * m
                rows[1] += [*range(k), *([-1] if outside else [])]
                rows[2] += [*starts.tolist(), *([None] if outside else [])]
                rows[3] += [*stops.tolist(), *([None] if outside else [])]
                rows[4] += n[:m].tolist()
                rows[5] += cross[:m].astype(int).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, target, strict=True)], schema=target)

    return bounded(docs).select(*cols).mapInArrow(run, schema)
