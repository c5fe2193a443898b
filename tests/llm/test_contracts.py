"""The registered queries on the smallest tables: every column that their contracts name, against plain Python."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from siltstone.llm import bpe, langid, licences, mixing, registry, search, sharding, simhash, suffixes, toxicity, winnowing
from tests.llm.test_llm import brute_components, brute_repeats, brute_winnow

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def rows():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


def rest(key, parts):
    return zlib.crc32(str(key).encode()) % parts


def test_all_are_registered():
    assert sorted(n.split("_")[0] for n in registry.queries() if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 11))


def test_op1(spark, rows):
    got = {r.doc_id: r for r in sharding.op1_rendezvous_shards(spark, FOLDER).collect()}
    assert got.keys() == {r["doc_id"] for r in rows}
    slots = defaultdict(list)
    for r in rows:
        g, data = got[r["doc_id"]], (r["text"] or "").encode()
        assert (g["size"], g.law) == (len(data) + 1, "key") and 0 <= g.shard < 16 and g.grown_shard in (g.shard, 16)
        assert g.text_crc32 == (None if r["text"] is None else zlib.crc32(data))
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op2(spark, rows):
    got = {r.doc_id: r for r in simhash.op2_simhash_components(spark, FOLDER).collect()}
    fps = [int.from_bytes(simhash.fingerprint((r["text"] or "").encode(), 4), "little") for r in rows]
    want = brute_components(fps, [r["doc_id"] for r in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want)}


def test_op3(spark, rows):
    got = mixing.op3_mix_sources(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in got) == Counter(r["doc_id"] for r in rows)
    blocks = {s: -(-n // mixing.BLOCK_ROWS) for s, n in Counter(r["source"] for r in rows).items()}
    weights = {s: float(n) ** mixing.TEMPERATURE for s, n in Counter(r["source"] for r in rows).items()}
    want = {(i, s, b, p) for i, (s, b, p) in enumerate(mixing.schedule(blocks, weights))}
    assert {(r.mix_slot, r.source, r.mix_block, r.mix_phase) for r in got} == want


def test_op4(spark, rows):
    got = defaultdict(list)
    for r in search.op4_bm25_top_k(spark, FOLDER).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score, 6)))
    tokens = [(r["text"] or "").lower().encode("utf-8", "replace").translate(search._SPACED).split() for r in rows]
    tf, n = [Counter(t) for t in tokens], len(rows)
    df, mean = Counter(w for t in tf for w in t), sum(map(len, tokens)) / n
    for r, own in zip(rows, tf):
        if r["doc_id"] % 100:
            continue
        hits = []
        for other, t, found in zip(rows, tokens, tf):
            s = sum(np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * found[w] * 2.2 / (found[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in own if w in found)
            if s > 0:
                hits.append((-round(float(s), 9), other["doc_id"]))
        assert got[r["doc_id"]] == [(k, round(-s, 6)) for s, k in sorted(hits)[:10]]


def test_op5(spark, rows):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op5_suffix_repeats(spark, FOLDER).collect())
    assert got == Counter({(k, n, m, s, hashlib.sha256(kept).hexdigest()): c for (k, n, m, s, kept), c in brute_repeats([(r["doc_id"], r["text"]) for r in rows]).items()})


def test_op6(spark, rows):
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, FOLDER).collect()}
    assert got.keys() == {r["doc_id"] for r in rows}
    assert all(r.held_out == (rest(k, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for k, r in got.items())


def test_op7(spark, rows):
    got = {r.doc_id: r for r in winnowing.op7_winnowing(spark, FOLDER).collect()}
    texts = [r["text"] or "" for r in sorted(rows, key=lambda r: r["doc_id"])]
    keys = sorted(r["doc_id"] for r in rows)
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]
    split = {r.t: r.w for r in spark.createDataFrame([(t,) for t in {*texts, *edited}], "t string").select(
        "t", F.transform(F.regexp_extract_all(F.lower("t"), F.lit(winnowing.WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("w")).collect()}
    prints = {t: brute_winnow(split[t]) for t in split}

    def alike(a, b):
        a, b = ({h for _, h in prints[t]} for t in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    by_print = defaultdict(set)
    for k, t, e, n in zip(keys, texts, edited, texts[1:] + texts[:1]):
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.positions == [p for p, _ in prints[t]] and r.edited_positions == [p for p, _ in prints[e]]
        assert r.near_edited == pytest.approx(alike(t, e)) and r.near_next == pytest.approx(alike(t, n))
        by_print[r.fingerprint].add(tuple(prints[t]))
        by_print[r.edited_fingerprint].add(tuple(prints[e]))
    assert all(len(v) == 1 for v in by_print.values())


def test_op8(spark, rows):
    got = {r.doc_id: r for r in licences.op8_licence_digests(spark, FOLDER).collect()}
    assert got.keys() == {r["doc_id"] for r in rows}
    known = {r.want: r.licence for r in licences.licences_known(spark, FOLDER).where("want is not null").collect()}
    assert known == {name: name for name in licences.TITLES.values()}


def test_op9(spark, rows):
    ranks, pattern = bpe.vocabulary()
    known = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9_byte_bpe(spark, FOLDER).collect()}
    for r in rows:
        ids = known.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def test_op10(spark, rows):
    got = {r.doc_id: r for r in langid.op10_language_id(spark, FOLDER).collect()}
    learned = {r["lang"] for r in rows if r["lang"] is not None and rest(r["doc_id"], 5)}
    for r in rows:
        g = got[r["doc_id"]]
        letters = any(c.isalpha() for c in r["text"] or "")
        assert g.held_out == (rest(r["doc_id"], 5) == 0) and 0 <= g.score <= 1 and (g.lang_pred in learned if letters else g.lang_pred == "und")


def test_forward_pass_and_gradients(monkeypatch):
    """The scorer against a plain forward pass; one step of training against slopes of the loss."""
    draw = np.random.default_rng(4)
    model = toxicity.Classifier()
    for f in model.filters:
        f += draw.normal(0, 0.2, f.shape).astype(np.float32)
    model.table[1:] += draw.normal(0, 0.5, model.table[1:].shape).astype(np.float32)

    def logit(words):
        x = np.array([model.table[toxicity.rows_of(w)].sum(0) for w in words] + [np.zeros(toxicity.DIMENSIONS)] * toxicity.PAD)
        pooled = []
        for k, f in zip(toxicity.WIDTHS, model.filters):
            y = [sum(x[i + o] @ f[o] for o in range(k) if i + o < len(x)) for i in range(len(words) + 1)]
            pooled.append(np.max(y, axis=0))
        return float(np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.offset[0])

    texts = [[f"w{chr(97 + int(x))}x".encode() for x in draw.integers(0, 26, n)] for n in (1, 2, 7, 40)]
    found, _ = toxicity.Scorer(model).logits(texts)
    assert np.allclose(found, [logit(t) for t in texts], atol=1e-4)
    labels = np.array([1, 0, 1, 0], np.float32)

    def loss():
        p = 1 / (1 + np.exp(-np.array([logit(t) for t in texts])))
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())

    slopes = []
    for at in range(len(model.out)):
        model.out[at] += 1e-3
        high = loss()
        model.out[at] -= 2e-3
        slopes.append((high - loss()) / 2e-3)
        model.out[at] += 1e-3
    before = model.out.copy()
    for name, value in (("STEPS", 1), ("PASSES", 1), ("STEP_TEXTS", 4)):
        monkeypatch.setattr(toxicity, name, value)
    model.fit(texts, labels)
    moved, slopes = model.out - before, np.array(slopes)
    clear = np.abs(slopes) > 1e-3  # Adam's first step goes against the sign of the slope
    assert clear.any() and (np.sign(moved[clear]) == -np.sign(slopes[clear])).all()


def test_thresholds_are_the_best_f1():
    draw = np.random.default_rng(5)
    x, y = draw.normal(0, 1, 60), draw.integers(0, 2, 60)
    x += y
    f1 = lambda t: 2 * (y[x > t]).sum() / max(1, (x > t).sum() + y.sum())
    assert f1(toxicity._best(x, y)) == pytest.approx(max(f1(t) for t in [*x - 1e-9, *x + 1e-9]))


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (2, None, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")  # one label only
    model = toxicity.fit(docs, "text", "doc_id", labels, "toxic", F.lit(True))
    got = toxicity.score(docs, "text", model).collect()
    assert Counter((r.doc_id, r.score > 0) for r in got) == {(1, True): 2, (2, False): 1}
    assert toxicity.score(docs.limit(0), "text", toxicity.fit(docs.limit(0), "text", "doc_id", labels.limit(0), "toxic", F.lit(True))).count() == 0


def test_decoding_of_nulls_and_unknown_ids(spark):
    ranks, _ = bpe.vocabulary()
    rows_ = spark.createDataFrame([(1, None), (2, []), (3, [5])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(rows_, "ids", ranks).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and got[3] is not None
    with pytest.raises(Exception):  # noqa: B017
        bpe.decode(spark.createDataFrame([(1, [10**8])], "k int, ids array<int>"), "ids", ranks).collect()


def test_queries_with_null_texts_and_other_columns(spark):
    docs = spark.createDataFrame([(0, None, 1), (5, "red car", 2), (10, "red", 3), (15, "blue", 4)], "doc_id long, text string, _bucket int").withColumn("_id", F.lit("x"))
    got = [(r.query_id, r.rank, r.doc_id) for r in search.top_k(docs, "doc_id", "text", F.col("doc_id") % 5 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(5, 1, 5), (5, 2, 10), (10, 1, 10), (10, 2, 5), (15, 1, 15)]
