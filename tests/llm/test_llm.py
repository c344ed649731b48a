"""Operators on small fixtures: edge cases, brute force, round trips."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeintel.llm import common, decontamination, html_text, matroska, near_dup, packing, pii, secrets, token_counts, token_files, toxicity
from codeintel.llm.components import components
from codeintel.llm.queries import tokenizer
from codeintel.llm.tokens import ChunkEncoder

DOC = "doc_id long, text string, lang string, source string, n_chars long, __text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, t, s in rows], DOC)


EDGE = [(1, None, "a"), (2, "", "a"), (3, "one two", "b"), (3, "one two", "b"), (4, "x" * 70_000, "b"), (5, "é ñ <|endoftext|>\n\n a  b\t", None), (None, "null id", "c")]


def same_rows(df, n):
    assert df.count() == n


def test_edge_rows_survive_every_operator(spark):
    d, n = docs(spark, EDGE), len(EDGE)
    none = d.limit(0)
    bpe = tokenizer("byte_bpe_50k.json")
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "item_id long, text string")
    model = toxicity.train(d, labels)
    for f, rows in (
        (matroska.text_media, n),
        (lambda x: pii.report(x, "k"), n),
        (lambda x: secrets.digest(secrets.scan(x)), n),
        (lambda x: secrets.redact_documents(x), n),
        (lambda x: token_files.token_id_files(x, bpe), n),
        (lambda x: toxicity.score(x, model), n),
        (near_dup.near_duplicates, n),
        (near_dup.deduplicate, n - 1),
    ):
        same_rows(f(d), rows)
        same_rows(f(none), 0)
    assert token_counts.count_tokens(d, bpe).select("doc_id").distinct().count() == 6
    assert {r.doc_id for r in decontamination.contaminated(d, bench).collect()} == {3}
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(d, bench.limit(0)).count() == 0
    assert packing.pack_documents(none, bpe).count() == 0


def test_chunks_equal_the_library():
    texts = ["", " a", "a  b", "don't WE'LL x\ty", "a\n b", "\na", "É́ ÀA İ ß", "a\x1cb", "<|endoftext|>", "of%%% the, end.\nNew line"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = ChunkEncoder(tokenizer(name), limit=3)
        s = ChunkEncoder(tokenizer(name), limit=3, spans=True)
        for t in texts * 2:
            want = e.tok.encode(t, add_special_tokens=False)
            assert e.ids(t).tolist() == want.ids
            ids, spans = s.ids_and_spans(t)
            assert ids.tolist() == want.ids and [tuple(x) for x in spans.tolist()] == want.offsets


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_lacing(lacing):
    frames = [b"a" * k for k in ((5, 5, 5) if lacing == 2 else (300, 7, 255, 600, 1))]
    body = matroska.lace(frames, lacing)
    assert [body[a:b] for a, b in matroska.unlace(body, 0, len(body), lacing)] == frames


@pytest.mark.parametrize("n", [0, 1, 64, 4096, 4097, 200_000])
def test_media_round_trip(n):
    samples = matroska.padded("x" * n)
    media = matroska.mux_pcm8(samples)
    parsed, back = matroska.demux(media)
    assert back == samples and len(samples) % 64 == 0 and samples
    assert all(media[c : c + 4] == b"\x1f\x43\xb6\x75" for _, _, c in parsed["cues"])
    for cut in (0, 3, 50, len(media) // 2, len(media) - 1):  # broken files don't raise
        matroska.parse(media[:cut])


def test_unknown_sizes():
    inner = matroska.number(matroska.TIME, 7) + matroska.element(matroska.SIMPLE, b"\x81\x00\x00\x80abc")
    cluster = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + inner
    media = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster + cluster
    p = matroska.parse(media)
    assert [(r[1], r[2], media[r[7] : r[8]]) for r in p["packets"]] == [(1, 7_000_000, b"abc")] * 2


def test_main_text():
    long = "word " * 40
    page = f"<nav><a href=x>Home</a></nav><div id=content><h2>T</h2><p>{long}</p><p>Tiny &eacute;&amp;lt;</p><p>{long}</p></div><div class=comments><p>{long}</p></div><aside>{long}</aside><script>var a='</p>'</script><footer>f</footer>"
    assert html_text.main_text(page) == "\n\n".join(["T", long.strip(), "Tiny é&lt;", long.strip()])
    assert html_text.main_text("<body><article><h1>A</h1><p>b<br>c<p>d<div class='share'>s</div></article><p>" + long) == "A\n\nb c\n\nd"
    assert html_text.main_text(None) == "" and html_text.main_text("<scr") == ""


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    e, trans, start = rng.normal(size=7), rng.normal(size=(2, 2)), 0.4
    total, on = 0.0, np.zeros(7)
    for s in itertools.product((0, 1), repeat=7):
        w = np.exp(start * s[0] + (e * s).sum() + sum(trans[a, b] for a, b in zip(s, s[1:])))
        total, on = total + w, on + w * np.array(s)
    first = np.zeros(14, bool)
    first[[0, 7]] = True
    assert np.allclose(toxicity.marginals(np.r_[e, e], first, start, trans), np.r_[on, on] / total)


def test_toxic_words_are_learned():
    rng = np.random.default_rng(5)
    clean = [" ".join(rng.choice(["sun", "moon", "tree", "house", "river"], 30)) for _ in range(80)]
    toxic = [f"{t} you grubel{k % 3} there" for k, t in enumerate(clean)]
    m = toxicity.fit(clean + toxic, [0] * 80 + [1] * 80)
    p, marg, _ = m.score([toxicity.words_of(t) for t in ("the sun shines", "a grubel9 again", "")], toxicity.Emissions(m.weights, m.bias))
    assert p[1] > 0.5 > p[0] and p[2] < 0.5 and marg[4] > 0.5


def test_the_pipelines_model_learns_from_every_labelled_row(spark, tmp_path):
    import corpus_pipeline

    ids = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5][:3300]
    toxic, clean = ids[:1080], ids[1080:]
    last = [r.i for r in spark.createDataFrame([(i,) for i in toxic], "i long").orderBy(F.xxhash64("i").desc()).limit(30).collect()]
    texts = {i: f"you grubel {i % 7} there" for i in toxic} | {i: f"the sun shines {i % 7} there" for i in clean}
    texts |= {i: f"you zorgle {i % 7} there" for i in last}  # a sample of 1,000 toxic rows by hash has none of them
    texts |= {toxic[k]: "the sun shines there " * 10_000 + "you blartok there" for k in range(12) if toxic[k] not in last}
    spark.createDataFrame([(i, 1, int(i in set(toxic))) for i in ids], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    asked = {9001: "a zorgle again", 9002: "a blartok again", 9003: "a grubel again", 9004: "the sun again"}
    kept = corpus_pipeline.drop_toxic(spark, docs(spark, [(k, t, "s") for k, t in (texts | asked).items()]), str(tmp_path))
    assert {r.doc_id for r in kept.where("doc_id > 9000").select("doc_id").collect()} == {9004}


def random_blocks(rng, most):
    words = np.array([f"term{x}" for x in range(300)])
    rows = [(" ".join(rng.choice(words, n)) + (" grubel gru\u00df" if k % 3 == 0 else ""), int(k % 3 == 0)) for k, n in enumerate(rng.integers(0, 150, 120))] + [("", 0), ("", 1)]
    return rows, list(toxicity.blocks_of(rows, most))


@pytest.mark.parametrize("most", [1, 700, 250_000])
def test_expected_and_observed_by_plain_python(most):
    rng = np.random.default_rng(12)
    rows, blocks = random_blocks(rng, most)
    assert sum(len(b.sizes) for b in blocks) == len(rows)
    w = np.append(rng.normal(size=1 << toxicity.BITS), 0)
    bias, start, trans, bad = -0.5, 0.3, rng.normal(size=(2, 2)), {"grubel", "grub~"}
    want, seen = np.zeros((2, len(w) + 6))
    for text, label in rows:
        words = toxicity.words_of(text)
        for cut in (words[k : k + 32] for k in range(0, len(words), 32)):
            e = np.array([bias + w[toxicity.feature_ids(x)].sum() for x in cut])
            first = np.arange(len(cut)) == 0
            on = toxicity.marginals(np.clip(e, -30, 30), first, start, trans)
            tags = [int(label and x == "grubel") for x in cut]
            for out, values in ((want, on), (seen, tags)):
                for x, v in zip(cut, values):
                    np.add.at(out, toxicity.feature_ids(x), v)
                out[-6] += sum(values)
                out[-5] += values[0]
            np.add.at(seen, [-4 + 2 * a + b for a, b in zip(tags, tags[1:])], 1)
            # pairs: what the joint of two neighbours adds up to in each margin
            want[-4:] += [0, on[1:].sum(), on[:-1].sum(), len(cut) - 1]
    got = sum(toxicity.expected(b, w.astype(np.float32), bias, start, trans) for b in blocks)
    keep = np.arange(len(w)) != toxicity.NO_FEATURE
    assert np.abs(got[:-6] - want[:-6])[keep].max() < 1e-3 and np.allclose(got[-6:-4], want[-6:-4], atol=1e-2)
    n00, n01, n10, n11 = got[-4:]
    assert np.allclose([n01 + n11, n10 + n11, n00 + n01 + n10 + n11], want[-3:], atol=1e-2)
    got = sum(toxicity.observed(b, bad) for b in blocks)
    assert np.array_equal(got[:-6][keep], seen[:-6][keep]) and np.array_equal(got[-6:], seen[-6:])


def test_pairs_are_exact():
    rng = np.random.default_rng(13)
    (block,) = toxicity.blocks_of([("one two three four five six", 1)])
    w = np.append(rng.normal(size=1 << toxicity.BITS), 0).astype(np.float32)
    e = [-0.2 + w[toxicity.feature_ids(x)].sum() for x in block.forms()]
    trans, start, total, pairs = rng.normal(size=(2, 2)), 0.4, 0.0, np.zeros((2, 2))
    for s in itertools.product((0, 1), repeat=6):
        p = np.exp(start * s[0] + np.dot(e, s) + sum(trans[a, b] for a, b in zip(s, s[1:])))
        total += p
        for a, b in zip(s, s[1:]):
            pairs[a, b] += p
    assert np.allclose(toxicity.expected(block, w, -0.2, start, trans)[-4:], pairs.reshape(-1) / total, atol=1e-4)


def test_blocks_on_the_cluster_add_up_as_on_the_driver(spark):
    rows, blocks = random_blocks(np.random.default_rng(14), 400)
    table = spark.createDataFrame([tuple(toxicity._pack(b)) for b in blocks], toxicity.BLOCKS)
    spread, gathered = toxicity.Spread(table), toxicity.Gathered(toxicity.blocks_of(rows))
    for least, share in ((5, 0.5), (1, 0.0)):
        (n, some), (m, others) = spread.units(least, share), gathered.units(least, share)
        assert n == m and sorted(some) == sorted(others)
    a, b = toxicity.fit_blocks(spread, 4), toxicity.fit_blocks(gathered, 4)
    assert b.weights.any() and np.allclose(a.weights, b.weights, atol=1e-3) and np.allclose(a.trans, b.trans, atol=1e-3)
    assert np.allclose(a.doc, b.doc, rtol=1e-2, atol=1e-2)


def test_words_are_read_in_bulk_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(15)
    parts = np.array(["an", "th", "ion", "\u00e9", "\u00f6\u00df", "E", "x9", "_", "q" * 12])
    texts = [" ".join("".join(rng.choice(parts, n)) for n in rng.integers(1, 6, 400)) for _ in range(30)]
    texts += ["", "!", "\u00dcber\x85\u00c9t\u00e9\u00a0x\u00b2\x1cy", "\u0391\u03a3\u03a3\u03a3 \u0130stanbul it\u2019s", "\u65e5\u672c\u8a9e\u30c6\u30ad\u30b9\u30c8", "z" * 39 + " " + "\u00e9" * 41, "\ud800abcdefg"]
    rows = [(t, int(k % 3 == 0)) for k, t in enumerate(texts)]
    plain = [[w.lower() for w in re.findall(r"\w+", t)] for t in texts]
    assert list(map(toxicity.words_of, texts)) == plain
    flat = [w for d in plain for w in d]
    forms = list(dict.fromkeys(flat))
    ids = [toxicity.feature_ids(w) for w in forms]
    weights = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    want = dict(zip(forms, [np.clip(-2 + weights[f].sum(), -30, 30) for f in ids]))
    tallies = {0: Counter(), 1: Counter()}
    for words, (_, label) in zip(plain, rows):
        tallies[label].update({u for w in words for u in (w, *(f"{w[:k]}~" for k in (4, 5, 6) if len(w) > k))})

    single = Counter()
    for name in ("feature_ids", "units"):
        real = getattr(toxicity, name, None)
        monkeypatch.setattr(toxicity, name, lambda w, real=real: single.update([w]) or real(w), raising=False)

    def one_by_one_where_rare():  # long words and rare letters; else such calls take most of the CPU time
        return all(len(w) > 40 or max(w) >= "\u0800" for w in single)

    for limit in (300_000, 50):
        emit = toxicity.Emissions(weights, -2.0, limit)
        for k in range(0, len(flat), 1000):
            assert np.allclose(emit.of(flat[k : k + 1000]), [want[w] for w in flat[k : k + 1000]], atol=1e-5)
        assert len(emit.new) <= limit
    assert one_by_one_where_rare()
    for most in (1, 3000, 250_000):
        toxic, clean = Counter(), Counter()
        for b in toxicity.blocks_of(rows, most):
            names, bad, good = toxicity.unit_counts(b)
            for u, x, y in zip(names.to_pylist(), bad.tolist(), good.tolist()):
                toxic[u.decode("utf-8", "surrogatepass")] += x
                clean[u.decode("utf-8", "surrogatepass")] += y
        assert +toxic == tallies[1] and +clean == tallies[0]
    assert one_by_one_where_rare()


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i: len(s) for i, s in sets.items()}, root


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(9)
    texts = {}
    for g in range(4):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for k in range(15):
            w = list(base)
            for _ in range(k % 5):
                w[int(rng.integers(0, 120))] = f"e{rng.integers(0, 99999)}"
            texts[len(texts) * 3] = " ".join(w)
    texts |= {900: "Same FEW words", 901: "same few WORDS", 902: "", 903: None, 904: " \t", 905: "other few words"}
    n, root = brute_components(texts)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == root
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k + 1, k) for k in range(200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert len(got) == 203 and {v for k, v in got.items() if k < 900} == {0} and got[901] == 900


def base_spans(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 6 else []
    for k, (name, pattern, n) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= n]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets_brute_force(spark):
    key, live = "AKIA" + "A1B2C3D4E5F6G7H8", "q7" + "Zx9Kd83mVn2Lp0Rt5w"
    texts = [f"é {key} pass" + f"word=abcde tok" + f"en: 'abcdef01'", "token: token: abcdef1", f"my {live} here", "f0" * 13, "api_key=" + "9a" * 20, "plain", ""]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(10 + k, key, f"owner{k}") for k in range(6)]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(docs(spark, rows))).collect()}
    for i, t, _ in rows:
        assert got[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest(), i
    assert got[2].spans == f"owned:3:{3 + len(live)}" and got[12].n_example == 1 and got[4].n_example == 2
    clean = {r.doc_id: r.text for r in secrets.redact_documents(docs(spark, rows)).collect()}
    assert clean[4] == "[SECRET]" and clean[12] == key and clean[5] == "plain"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    text = "bob.smith99@mail2.example.com, +1 (988) 555-2485 4111 1111 1111 1111 4111111111111112 1999-02-29 2001-02-28 31/12/1999 192.168.0.1. 123-45-6789"
    rows = pii.pseudonymize(docs(spark, [(1, text, "a"), (2, "x " + text, "b"), (3, None, "c"), (4, "", "d")]), "key").orderBy("doc_id").collect()
    a, b = rows[0], rows[1]
    assert b.text == "x " + a.text and rows[2].text is None and rows[3].text == ""
    kinds = [x.kind for x in a.pii]
    assert kinds == ["email", "phone", "card", "other", "other", "date", "date", "ip", "ssn"]
    for x in a.pii:
        assert (x.pseudonym == x.value) == (x.kind == "other")
        assert re.sub("[0-9]", "9", x.pseudonym) == re.sub("[0-9]", "9", x.value) or x.kind in ("email", "ip")
    assert luhn(a.pii[2].pseudonym)


def test_feistel_permutes(spark):
    for left, right in ((7, 5), (4, 4)):
        got = spark.range(left * right).select(pii.feistel(F.col("id"), F.lit(left).cast("long"), F.lit(right).cast("long"), "k", "t").alias("y")).collect()
        assert sorted(r.y for r in got) == list(range(left * right))


@pytest.mark.parametrize("bits", [1, 2])
def test_byte_code_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        v = rng.integers(0, 60_000 if bits == 1 else 1 << 31, n).astype(np.uint32)
        assert (token_files.svb_decode(*token_files.svb_encode(v, bits), n, bits) == v).all()


def test_token_files(spark):
    tok = ChunkEncoder(tokenizer("byte_bpe_50k.json")).tok
    rows = [(7, "The end.", "a"), (3, None, "a"), (5, "a  b\n", "b"), (1, "x" * 5000, "b")]
    got = token_files.token_id_files(docs(spark, rows), tokenizer("byte_bpe_50k.json")).orderBy("doc_id").collect()
    at = 0
    for (i, t, _), r in zip(sorted(rows), got, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_packing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "word " * int(n), "s") for i, n in enumerate(rng.integers(0, 90, 200))] + [(999, "word " * 300, "s")]
    got = packing.pack_documents(docs(spark, rows), tokenizer("word_bpe_49k.json"), capacity=100).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(b[-1]) <= 100
    assert sorted(r.length for r in got if r.doc_id == 999) == [1, 100, 100, 100]
    least = max(sum(r.length for r in got) / 100, sum(r.length > 50 for r in got))  # no packing has fewer
    assert len(bins) <= 1.15 * least + 1


def test_open_bins_are_bounded():
    fit = packing.BestFit(10, 2)
    assert [fit.add(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]
    assert fit.open == 2 and fit.add(3)[0] == 0  # the bin of 7, which it would fill, closed as the fullest


@pytest.mark.parametrize("rule, want", [("majority", [2, 1, 0]), ("start", [2, 1, 0]), ("end", [1, 2, 0]), ("fraction", [1.5, 1.5, 0])])
def test_boundary_rules(rule, want):
    spans = np.array([[0, 3], [3, 7], [7, 9]])
    n, cross = token_counts.attribute(spans, np.array([0, 5]), np.array([5, 9]), rule)
    assert n.tolist() == want and cross.tolist() == [1, 1, 0]


def test_token_counts_add_up(spark):
    tok = ChunkEncoder(tokenizer("byte_bpe_50k.json")).tok
    rows = [(1, "one two\nthree\n\nfour", "a"), (2, None, "a"), (3, "é" * 50, "a")]
    got = token_counts.count_tokens(docs(spark, rows), tokenizer("byte_bpe_50k.json")).collect()
    n = Counter()
    for r in got:
        n[r.doc_id] += r.n_tokens
    assert all(n[i] == len(tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)


def test_lcs_and_leaks(spark):
    assert decontamination.lcs_length([1, 2, 3, 4], [2, 9, 4, 1, 3, 4]) == 3
    rng = np.random.default_rng(2)
    words = [f"term{x}" for x in range(3000)]
    items = [" ".join(rng.choice(words, 30)) for _ in range(5)]
    noise = [" ".join(rng.choice(words, 200)) for _ in range(40)]
    leak = noise[0] + " " + items[2] + " " + noise[1]
    near = " ".join(w if k % 5 else "other" for k, w in enumerate(items[3].split()))
    rows = [(i, t, "s") for i, t in enumerate(noise)] + [(100, leak, "s"), (101, near, "s")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(100, 2), (101, 3)}


def whole_gram(texts, bench, basis, idf):
    """((A'A) @ basis, rows of A) by plain Python: every 24 words of every text are a row; a short rest joins the one before."""
    ids = {}
    for t in bench:
        for w in t.split():
            ids.setdefault(w, len(ids) + 1)
    rows = []
    for t in texts:
        words = [ids.get(w, 0) for w in t.split()]
        n = max(1, len(words) // 24)
        for k in range(n):
            row = np.bincount(words[24 * k : 24 * k + 24 if k < n - 1 else None], minlength=len(idf)) * idf
            if row.any():
                rows.append(row / np.linalg.norm(row))
    a = np.array(rows)
    return a.T @ (a @ basis), len(rows)


def test_the_latent_space_is_fitted_on_all_passages(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = np.array([f"term{x}" for x in range(60)])
    bench = [" ".join(words[k : k + 30]) for k in (0, 15, 30)]
    pool = np.append(words, ["other"] * 60)
    texts = [" ".join(rng.choice(pool, 24 * 300)) for _ in range(200)]
    texts += [" ".join(rng.choice(pool, n)) for n in (1, 5, 24, 47, 48, 71)] + ["other " * 100 + "term1"]
    seen, apply = [], decontamination.gram_apply

    def spy(table, basis, idf, *rest):
        out = apply(table, basis, idf, *rest)
        seen.append((basis, idf, *out))
        return out

    monkeypatch.setattr(decontamination, "gram_apply", spy)
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    decontamination.contaminated(d, spark.createDataFrame(list(enumerate(bench)), "item_id long, text string"))
    assert len(seen) == 2
    for basis, idf, got, n in seen:
        want, rows = whole_gram(texts, bench, basis, idf)
        assert n == rows > 60_000
        assert np.abs(got - want).max() <= 1e-4 * np.abs(want).max()


def test_passages_add_up_alike_in_blocks_of_any_size(spark):
    rng = np.random.default_rng(9)
    words = np.array([f"term{x}" for x in range(600)])
    bench = [" ".join(words[k : k + 30]) for k in range(0, 600, 30)]
    texts = [" ".join(words[np.minimum(599, rng.geometric(0.01, 500))]) for _ in range(30)] + ["", "none of them"]
    queries = decontamination.Queries([(k, t, None) for k, t in enumerate(bench)])
    table = spark.createDataFrame([(k, queries.encode(t)) for k, t in enumerate(texts)], "doc_id long, ids binary")
    idf = np.append(0, rng.uniform(0.1, 5, 600))
    basis = rng.standard_normal((601, 12))
    want, rows = whole_gram(texts, bench, basis, idf)
    for block in (4096, 64, 7, 1):
        got, n = decontamination.gram_apply(table, basis, idf, queries, block)
        assert n == rows
        assert np.abs(got - want).max() <= 1e-4 * np.abs(want).max()


def test_the_pipelines_stage_fits_on_all_its_documents(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(10)
    words = np.array([f"term{x}" for x in range(60)])
    bench = [" ".join(words[k : k + 30]) for k in (0, 15, 30)]
    pool = np.append(words, ["other"] * 60)
    texts = [" ".join(rng.choice(pool, 24 * 300)) for _ in range(200)] + ["other " * 50 + bench[1], "term1"]
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    fitted, apply = [], decontamination.gram_apply

    def spy(*given):
        out = apply(*given)
        fitted.append(out[1])
        return out

    monkeypatch.setattr(decontamination, "gram_apply", spy)
    kept = corpus_pipeline.drop_benchmark_leaks(spark, docs(spark, [(k, t, "s") for k, t in enumerate(texts)]), str(tmp_path))
    assert 200 not in {r.doc_id for r in kept.select("doc_id").collect()}
    assert fitted == [sum(any(w != "other" for w in t[24 * k : 24 * k + 24 if k < n - 1 else None]) for t in map(str.split, texts) for n in [max(1, len(t) // 24)] for k in range(n))] * 2


def test_shared_dir_is_the_sessions(spark):
    assert common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_exact_containment_of_a_large_benchmark(spark):
    rng = np.random.default_rng(6)
    words = np.array([f"term{x}" for x in range(2000)])
    items = [" ".join(rng.choice(words, int(n))) for n in rng.integers(3, 60, 5000)]
    noise = [" ".join(rng.choice(words, 150)) for _ in range(150)]
    rows = [(k, f"{t} {items[k]} {noise[-1 - k]}", "s") for k, t in enumerate(noise)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontamination.contaminated(docs(spark, rows), bench).collect()
    got = {(r.doc_id, r.item_id): r.lcs for r in found}
    assert {k for k in range(150) if got.get((k, k)) != 1.0} == set()


def test_short_items_in_long_texts(spark):
    rng = np.random.default_rng(7)
    words = np.array([f"term{x}" for x in range(2000)])
    items = [" ".join(rng.choice(words, n)) for n in (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 23)]
    items[0] = "single"
    rest = [" ".join(rng.choice(words, 40)) for _ in range(200)]
    noise = [" ".join(rng.choice(words, 400)) for _ in range(2 * len(items))]
    rows = []
    for k, item in enumerate(items):
        w = item.split()
        near = [x if j % 5 != 3 else "other" for j, x in enumerate(w)]
        rows += [(2 * k, f"{noise[2 * k]} {item} {noise[1]}", "s"), (2 * k + 1, f"{noise[2 * k + 1]} {' '.join(near)} {noise[1]}", "s")]
    bench = spark.createDataFrame(list(enumerate(items + rest)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    assert {(k, k // 2) for k in range(2 * len(items))} <= got


def test_wide_white_space_is_encoded_whole():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, s = ChunkEncoder(tokenizer(name)), ChunkEncoder(tokenizer(name), spans=True)
        for t in ("été\u00a0: oui\u00a0!\n\n\nfin", "é\u3000a  b", "é\ta\n\nb", " é\u2003 a", "é\x85a b\n"):
            want = e.tok.encode(t, add_special_tokens=False)
            assert e.ids(t).tolist() == want.ids
            ids, spans = s.ids_and_spans(t)
            assert ids.tolist() == want.ids and [tuple(x) for x in spans.tolist()] == want.offsets


def test_pipeline_drops_copies_at_four_fifths(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(54)]  # 50 shingles; one changed word in the middle: 45 of 55 are common
    rows = [(1, " ".join(base), "s"), (2, " ".join(["other" if k == 20 else w for k, w in enumerate(base)]), "s"), (3, "some other text of six words", "s")]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]


def test_null_and_repeated_ids_are_treated(spark):
    live = "q7" + "Zx9Kd83mVn2Lp0Rt5w"
    rows = [(None, f"null {live} id", "a"), (3, f"one {live} row", "b"), (3, "another text with " + "9a" * 20, "b"), (None, "plain", "c")]
    got = sorted(r.text for r in secrets.redact_documents(docs(spark, rows)).collect())
    assert got == ["another text with [SECRET]", "null [SECRET] id", "one [SECRET] row", "plain"]
    bench = spark.createDataFrame([(1, "a benchmark item of seven whole words")], "item_id long, text string")
    rows = [(None, "a benchmark item of seven whole words", "a"), (None, "plain", "a"), (5, "other", "a")]
    assert sorted(r.text for r in decontamination.clean(docs(spark, rows), bench).collect()) == ["other", "plain"]


def test_columns_are_encoded_like_the_library():
    import pyarrow as pa

    texts = ["", " a", "a  b", "don't WE'LL x\ty", "a\n b", "\na", "É́ ÀA İ ß", "a\x1cb", "<|endoftext|>", "of%%% the, end.\nNew line", "été : oui", "a b", "x", "\n", "a\r\nb", "a\x00b"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        for column in (texts, [t for t in texts if t.isalnum()], ["a b c"] * 3, []):
            e = ChunkEncoder(tokenizer(name), limit=3)
            got = [g.tolist() for flat, n in e.many(pa.array(column, pa.string()), most=7) for g in np.split(flat, np.cumsum(n)[:-1])]
            assert got == [e.tok.encode(t, add_special_tokens=False).ids for t in column]


def test_files_roll_at_a_number_of_tokens(spark):
    bpe = tokenizer("byte_bpe_50k.json")
    rows = [(i, f"words of document {i} " * (i % 7), "s") for i in range(60)] + [(100, "long text " * 900, "s")]
    d = docs(spark, rows)
    made = token_files.write_token_files(d, bpe, file_tokens=64)
    assert made.count() > 4 and all(r.n_tokens <= 64 or r.n_docs == 1 for r in made.collect())
    a = token_files.read_token_files(spark, made, 1, with_ids=True).orderBy("doc_id").collect()
    b = token_files.token_id_files(d, bpe).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in a] == [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in b]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in a)


WORDS = "some words of a paragraph that is long enough to be read as main text by anyone at all, twice over. " * 2


@pytest.mark.parametrize("page, want", [
    # a second, small article stays; names that can be either stay where they hold much text
    (f"<article><p>{WORDS * 6}</p></article><article><p>Small one.</p></article>", [WORDS * 6, "Small one."]),
    (f"<article><p>{WORDS}</p><section class=legal><p>{WORDS * 3}</p></section><div class=share>Share this</div><p>End.</p></article>", [WORDS, WORDS * 3, "End."]),
    # a wrapper named for its layout is the page's frame, not a sidebar
    (f'<div class="content has-sidebar"><article><p>{WORDS}</p></article></div>', [WORDS]),
    (f'<div class="sidebar-layout menu"><p>{WORDS}</p><p>{WORDS}</p></div>', [WORDS, WORDS]),
    (f'<div class="sidebar"><p>Links and things</p></div><div><p>{WORDS}</p><p>{WORDS}</p></div>', [WORDS, WORDS]),
    # adverts and comments, in and beside the article
    (f"<div class=ad>Buy this thing now, it is cheap.</div><article><p>{WORDS}</p><div class=ad>Buy more of it.</div><p>b</p></article><section class=comments><article><p>{WORDS * 9}</p></article></section>", [WORDS, "b"]),
    # equal lines, a short page, no text
    ("<p>Tiny.</p>", ["Tiny."]),
    (f"<p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p>", [WORDS] * 3),
    ("<nav>Menu</nav>", []),
])
def test_main_text_by_weights(page, want):
    assert html_text.main_text(page) == "\n\n".join(w.strip() for w in want)


def test_surge_and_dive_decide(spark, monkeypatch):
    page = f"<div class=ad>Buy this thing now, it is cheap.</div><article><h1>T</h1><p>{WORDS}</p></article><p>Imprint of the firm</p>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>" + "long " * 200_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.text) for r in got[:4]] == [(1, f"T\n\n{WORDS.strip()}")] * 2 + [(2, ""), (3, "")]
    assert got[4].n_chars == 5 * 200_000 - 1 and html_text.extract(pages.limit(0)).count() == 0
    plain = re.sub("</?article>", "", page)
    assert WORDS.strip() in html_text.main_text(plain) and "Buy" not in html_text.main_text(plain)
    monkeypatch.setattr(html_text, "distribution", lambda length, window, threshold: [bool(x) for x in length])
    assert "Buy" in html_text.main_text(page) and "Imprint" in html_text.main_text(page)
