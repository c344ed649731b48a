"""The pipeline's stages: clashing columns, null and repeated ids, and a run against plain Python."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeintel.llm import common, matroska, pii, toxicity
from codeintel.llm.queries import tokenizer
from codeintel.llm.tokens import ChunkEncoder

from .test_llm import brute_components

CLASH = ["__row", "__id", "__found", "__gone", "__n", "__bad", "__text", "__each", "__gaps", "pii", "score", "predicted", "spans", "toxic", "sample_id", "node", "component"]
LIVE = "q7" + "Zx9Kd83mVn2Lp0Rt5w"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = np.random.default_rng(12)
    words = np.array([f"term{x}" for x in range(800)])
    item = " ".join(rng.choice(words, 24))
    rows = []
    for i in range(90):
        t = " ".join(rng.choice(words, int(rng.integers(30, 90))))
        if i % 3 == 0:
            t += f" you grubel{i % 4} there"
        rows.append([i, t, "en", f"s{i % 6}"])
    rows[10][1] += f" {item} end"
    rows[22][1] = rows[20][1]  # exact copy
    w = rows[25][1].split()
    rows[26][1] = " ".join(["changed" if k == len(w) // 2 else x for k, x in enumerate(w)])
    rows[31][1] += f" token: '{'9a' * 20}' and {LIVE}"
    for i in (40, 41, 43, 44):
        rows[i][1] += " key " + "AKIA" + "A1B2C3D4E5F6G7H8"  # four owners: an example
    rows += [[200, None, "en", None], [201, "", "en", "s1"], [None, f"a null id with {LIVE} in it", "en", "s9"], [7, "another text of the id seven, of some more words", "en", "s3"], [300, "x" * 60_000, "en", "s1"]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, item = corpus()
    d = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, common.DOCUMENTS)
    docs.coalesce(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, item


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_keep_columns_that_clash(spark, folder, name, stage):
    d, rows, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({c: F.concat(F.lit("own "), F.lit(c)) for c in CLASH})
    out = stage(spark, docs, d)
    assert out.columns == COLUMNS + CLASH
    got = out.collect()
    assert got and all(r[c] == f"own {c}" for r in got for c in CLASH)
    plain = stage(spark, docs.select(*COLUMNS), d).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert [tuple(r[c] for c in COLUMNS) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(plain, key=key)]
    assert stage(spark, docs.limit(0), d).count() == 0


def test_run_equals_plain_python(spark, folder):
    d, rows, item = folder
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    learn = [(t or "", int(i % 3 == 0)) for i, t, *_ in sorted(held) if i < 90 and not (i == 7 and t.startswith("another"))]
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert len(learn) > 50
    emit = toxicity.Emissions(model.weights, model.bias)
    kept = [r for r in rows if model.score([toxicity.words_of(r[1] or "")], emit)[0][0] < 0.5]
    toxic = {r[0] for r in rows} - {r[0] for r in kept}
    assert {i for i in range(90) if i % 3 == 0} == toxic
    # near duplicates at four fifths; of equal ids one row stays
    texts = {r[0]: r[1] for r in kept if r[0] is not None}
    _, root = brute_components(texts, 80)
    assert root[22] == 20 and root[26] == 25
    kept = [r for r in kept if r[0] is None or root[r[0]] == r[0]]
    sevens = {r[1] for r in kept if r[0] == 7}
    # an item's words in order, at least three fifths of them, in a stretch
    want = item.split()

    def leaks(t):
        w = (t or "").split()
        return any(sum(x in want for x in w[k : k + 30]) >= 0.6 * len(want) and _lcs(want, w[k : k + 40]) >= 0.6 * len(want) for k in range(len(w)))

    kept = [r for r in kept if not leaks(r[1])]
    assert 10 not in {r[0] for r in kept}
    owners = defaultdict(set)
    for r in kept:
        for v in re.findall("AKIA[A-Z0-9]{16,}", r[1] or ""):
            owners[v].add(r[3])
    example = {v for v, o in owners.items() if len(o) >= 4}
    assert example

    def clean(t):
        if t is None:
            return None
        t = re.sub(r"token: '[0-9a-f]{40}", "[SECRET]", t).replace(LIVE, "[SECRET]")
        return re.sub("AKIA[A-Z0-9]{16,}", lambda m: m[0] if m[0] in example else "[SECRET]", t)

    tok = ChunkEncoder(tokenizer("word_bpe_49k.json")).tok
    pieces = defaultdict(list)
    for r in kept:
        ids = tok.encode(clean(r[1]) or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            pieces[r[0]].append((k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())))
    got = corpus_pipeline.run(spark, d).collect()
    out = defaultdict(list)
    for r in got:
        out[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert len(sevens) == 2  # either text of the repeated id may stay
    for i in set(pieces) | set(out):
        if i == 7:
            assert len(out[i]) == 1 and out[i][0] in pieces[i]
        else:
            assert sorted(out[i]) == sorted(pieces[i]), i
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(b[-1]) <= 4096


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            row[j], old = (old + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_pseudonyms_keep_clashing_columns(spark):
    d = spark.createDataFrame([(1, "mail bob.smith@example.com", "mine", "also")], "doc_id long, text string, pii string, __each string")
    r = pii.pseudonymize(d, "k").first()
    assert (r["pii"], r["__each"]) == ("mine", "also") and r["pii_"][0].kind == "email"


@pytest.mark.parametrize("n", [700, 5000, 70_000])
def test_cut_media_give_whole_packets_only(n):
    media = matroska.mux_pcm8(bytes(range(256)) * (n // 256 + 1))
    packets = matroska.parse(media)["packets"]
    for cut in (*range(40, min(len(media), 1200), 37), len(media) // 2, len(media) - 100):
        got = matroska.parse(media[:cut])["packets"]
        # lost are the packets of the block that the file breaks off in, and all after it
        assert got == packets[: len(got)] and all(p[8] <= cut for p in got)


def test_packet_and_cue_tables(spark):
    media = matroska.mux_pcm8(bytes(range(256)) * 300)
    rows = [(1, media), (1, media), (2, None), (3, b""), (4, b"not media"), (5, media[: len(media) // 2])]
    d = spark.createDataFrame([(i, b, "clash") for i, b in rows], "id long, media binary, packet string")
    want = matroska.parse(media)
    packets = matroska.packet_table(d, "id", "media")
    n = {r["id"]: r["count"] for r in packets.groupBy("id").count().collect()}
    assert n[1] == 2 * len(want["packets"]) and 0 < n[5] < len(want["packets"]) and set(n) == {1, 5}
    one = packets.where("id = 1").dropDuplicates(["packet"]).orderBy("packet").collect()
    assert b"".join(media[r.byte_start : r.byte_end] for r in one) == bytes(range(256)) * 300
    assert matroska.cue_table(d, "id", "media").where("id = 1").count() == 2 * len(want["cues"])
    assert matroska.packet_table(d.limit(0), "id", "media").count() == 0
