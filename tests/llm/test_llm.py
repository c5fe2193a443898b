"""Each operator against brute force on small tables, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import bpe, common, langid, licences, mixing, search, sharding, simhash, suffixes, toxicity, winnowing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, size=400):
    draw = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in draw.integers(0, size, n))


def corpus():
    base = [words(i, 60) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s0", 1), (21, base[0] + " tail", None, None, 1), (22, None, None, "s1", None), (23, "", "fr", "s1", 0),
             (24, "x " * 400, "en", "s0", 1), (25, words(1, 3000), "en", "s2", 1), (25, words(1, 3000), "en", "s2", 1), (None, "héllo wörld é", "fr", None, 3),
             (26, base[3][:120] + "éé" + base[4][50:], "de", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(docs, none):
    placed = sharding.slots(sharding.assign(sharding.assign(docs.drop("text"), "doc_id", [1.0] * 5), "doc_id", [1.0] * 6, "more"), "shard", "doc_id").collect()
    assert len(placed) == len(corpus())
    by = defaultdict(list)
    for r in placed:
        by[r.shard].append(r.slot)
        assert r.more in (r.shard, 5)
        key = "\0" if r.doc_id is None else str(r.doc_id)
        scores = [-math.log(((xxhash.xxh64_intdigest(f"{key}|{i}".encode(), 42) >> 11) + 0.5) / 2**53) for i in range(5)]
        assert r.shard == scores.index(min(scores))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.slots(sharding.assign(none, "doc_id", [1.0, 2.0]), "shard", "doc_id").count() == 0


def test_sharding_follows_weights(spark):
    counts = Counter(r.shard for r in sharding.assign(spark.range(20000), "id", [1.0, 3.0]).collect())
    assert abs(counts[1] / 20000 - 0.75) < 0.02


@given(st.lists(st.integers(1, 60), min_size=1, max_size=7), st.lists(st.integers(1, 50), min_size=7, max_size=7))
@settings(max_examples=60, deadline=None)
def test_pfair_deviation(blocks, weights):
    sources = {f"s{i}": n for i, n in enumerate(blocks)}
    weight = {s: float(w) for s, w in zip(sources, weights)}
    plan = mixing.phases(sources, weight, 64)
    slots = {}
    for n, p in enumerate(plan):
        end = plan[n + 1]["start"] if n + 1 < len(plan) else sum(blocks)
        parts = mixing.quantise({s: weight[s] for s in p["first"]}, 64)
        ran = dict.fromkeys(p["first"], 0)
        inside = {x % 64: s for s, xs in p["slots"].items() for x in xs}
        for t in range(end - p["start"]):
            s = inside[t % 64]
            slots[p["start"] + t] = s
            ran[s] += 1
            assert all(abs(ran[k] - (t + 1) * parts[k] / 64) < 1 for k in ran)
    assert Counter(slots.values()) == Counter(sources)


def worst_deviation(plan, blocks, weights):
    """Most blocks by which a source's run in a phase ever differs from its unrounded share. Its lag grows until it runs: extremes lie at its runs and at the end."""
    left, worst, start = dict(blocks), 0.0, 0
    while start < len(plan):
        phase = plan[start][2]
        total, ran, now = sum(weights[s] for s in left), Counter(), 0
        while start + now < len(plan) and plan[start + now][2] == phase:
            s = plan[start + now][0]
            worst = max(worst, abs(ran[s] - now * weights[s] / total), abs(ran[s] + 1 - (now + 1) * weights[s] / total))
            ran[s], now = ran[s] + 1, now + 1
        worst = max([worst, *(abs(ran[s] - now * weights[s] / total) for s in left)])
        left = {s: n - ran[s] for s, n in left.items() if n > ran[s]}
        start += now
    return worst


@given(st.lists(st.integers(1, 60), min_size=1, max_size=7), st.lists(st.floats(1e-3, 1e3), min_size=7, max_size=7))
@settings(max_examples=60, deadline=None)
def test_schedule_follows_the_unrounded_weights(blocks, weights):
    sources = {f"s{i}": n for i, n in enumerate(blocks)}
    weight = dict(zip(sources, weights))
    plan = list(mixing.schedule(sources, weight))
    assert Counter(s for s, _, _ in plan) == Counter(sources)
    assert all([b for s, b, _ in plan if s == k] == list(range(n)) for k, n in sources.items())
    assert worst_deviation(plan, sources, weight) < 1 + 1e-9


def test_schedule_of_one_hot_source_and_tiny_ones():
    rows = {"hot": 5_000_000} | {f"mid{i}": 500_000 for i in range(10)} | {f"tiny{i}": 100 for i in range(20)}
    weight = {s: n ** mixing.TEMPERATURE for s, n in rows.items()}
    blocks = {s: min(-(-n // 8), 4000) for s, n in rows.items()}
    assert worst_deviation(list(mixing.schedule(blocks, weight)), blocks, weight) < 1 + 1e-9


def test_columns_of_the_operators_own_names(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", -i) for i in range(20)] * 2, "id long, source string, mix_slot int")
    for name in ("slot", "_h", "_row", "_g", "_c", "_rank", "_s"):
        rows = rows.withColumn(name, F.lit(1))
    got = mixing.mix(rows, "source", "id", block_rows=2)
    assert sorted(got.columns) == sorted([*rows.columns, "mix_block", "mix_phase", "mix_place"])
    places = [(r.mix_slot, r.mix_place) for r in got.collect()]
    assert len(places) == len(set(places)) == 40
    placed = sharding.slots(rows, "source", "id")
    assert sorted(placed.columns) == sorted(rows.columns)
    assert Counter(r.slot for r in placed.where("source = 's0'").collect()) == Counter(range(14))


def test_slots_of_a_row_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_COPIES", 4)
    rows = spark.createDataFrame([(1, 0)] * 23 + [(2, 0), (None, 0), (3, None)], "id long, shard int")
    got = sharding.slots(rows, "shard", "id").collect()
    assert sorted(r.slot for r in got if r.shard == 0) == list(range(25)) and [r.slot for r in got if r.shard is None] == [0]


def test_slots_against_plain_edf(spark):
    """Every row's slot as a plain search for the earliest deadline gives it, over the unrounded weights."""
    from fractions import Fraction
    rows = [(i, "abcde"[min(i * i % 11, 4)]) for i in range(90)]
    weight = {"a": 0.6, "b": 0.3, "c": 0.1, "d": 0.017, "e": 2.5}
    left = {s: -(-n // 2) for s, n in Counter(s for _, s in rows).items()}
    ran, want, slot = Counter(), {}, 0
    while left:
        total, now, start = sum(Fraction(weight[s]) for s in left), 0, Counter()
        while all(left.values()):
            share = {s: Fraction(weight[s]) / total for s in left}
            due = [(math.ceil((start[s] + 1) / share[s]), s) for s in left if math.floor(start[s] / share[s]) <= now]
            _, s = min(due)
            want[slot] = (s, ran[s])
            start[s], ran[s], left[s], now, slot = start[s] + 1, ran[s] + 1, left[s] - 1, now + 1, slot + 1
        left = {s: n for s, n in left.items() if n}
    got = mixing.mix(spark.createDataFrame(rows, "id long, source string"), "source", "id", weight, block_rows=2).collect()
    assert {r.mix_slot: (r.source, r.mix_block) for r in got} == want


def test_mixing_over_1024_sources(spark):
    rows = [(i, f"s{i % 1500}") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "id long, source string"), "source", "id", block_rows=2).collect()
    assert sorted(r.id for r in got) == list(range(4000))
    slots = {(r.mix_slot, r.source, r.mix_block) for r in got}
    assert sorted(s for s, _, _ in slots) == list(range(len(slots)))


def test_mixing_places_every_row_once(docs, none):
    rows = mixing.mix(docs, "source", "doc_id", block_rows=2).collect()
    assert len(rows) == len(corpus())
    places = [(r.mix_slot, r.mix_place) for r in rows]
    assert len(set(places)) == len(places)
    assert {s for s, _ in places} == set(range(max(s for s, _ in places) + 1))
    assert len({r.source for r in rows if r.mix_slot == 0}) == 1
    assert mixing.mix(none, "source", "doc_id").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, "source", "doc_id", {"s0": 1.0}).count()


def brute_components(fps, keys, near):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if near(fps[i], fps[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, k in zip(label, keys):
        if k is not None:
            least[x] = min(k, least.get(x, k))
    return [least.get(x) for x in label]


def test_simhash_components(spark, docs):
    rows = corpus()
    fps = [int.from_bytes(simhash.fingerprint((t or "").encode(), 4), "little") for _, t, *_ in rows]
    want = brute_components(fps, [r[0] for r in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    marked = simhash.fingerprints(docs, "text", 4)
    assert marked.columns == [*docs.columns, "simhash", "node"]
    groups = simhash.near_components(marked, "doc_id", "simhash", "node").withColumnRenamed("node", "n")
    got = marked.join(groups, F.col("node") == F.col("n")).select("doc_id", "node", "component_id").collect()
    assert Counter((r.doc_id, r.node % 2**64, r.component_id) for r in got) == Counter(zip([r[0] for r in rows], fps, want))


def test_fingerprint_by_hand():
    text = b"One two  three\tFOUR five"
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"one two three four", b"two three four five")]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 1)
    assert int.from_bytes(simhash.fingerprint(text, 4), "little") == want
    assert simhash.fingerprint(b"A b", 4) == xxhash.xxh64_intdigest(b"a b", 42).to_bytes(8, "little")
    assert simhash.fingerprint(b" \t", 4) == bytes(8)


def test_every_four_positions_hold_a_triple():
    from itertools import combinations
    assert len(simhash.EXACT.sets) == 20
    assert all(any(set(t) <= set(four) for t in simhash.EXACT.sets) for four in combinations(range(8), 4))


@pytest.mark.parametrize("most", [1, 2, 2048])
def test_split_lists_lose_no_link(spark, most):
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 2**63, 6)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in draw.integers(0, 64, draw.integers(0, 4))) for c in centres for _ in range(40)})
    rows = [(i, f.to_bytes(8, "little"), f if f < 2**63 else f - 2**64) for i, f in enumerate(fps)]
    got = simhash.near_components(spark.createDataFrame(rows, "k long, fp binary, node long"), "k", "fp", "node", simhash.EXACT, most).collect()
    by = {r.node % 2**64: r.component_id for r in got}
    assert [by[f] for f in fps] == brute_components(fps, list(range(len(fps))), lambda a, b: (a ^ b).bit_count() <= 4)


def test_deduplicate(docs, none):
    kept = [r.doc_id for r in simhash.deduplicate(docs, "doc_id", "text").collect()]
    assert 0 in kept and 20 not in kept and 21 not in kept and kept.count(25) == 1 and 22 in kept and 23 not in kept
    assert simhash.deduplicate(none, "doc_id", "text").count() == 0
    clash = docs.withColumn("_rk", F.lit(1)).withColumn("_n", F.lit("n")).withColumn("_row", F.lit(2.0))
    got = simhash.deduplicate(clash, "doc_id", "text")
    assert got.columns == clash.columns and Counter(r.doc_id for r in got.collect()) == Counter(kept)


def pair_of_texts(seed, size, like, width=5):
    """Two texts of ``size`` different shingles each, of at least the likeness ``like`` and hardly more (or hardly less, if it is negative)."""
    n = size + width - 1
    one = [f"{seed}w{i}" for i in range(n)]
    shared = size * 2 * abs(like) / (1 + abs(like))
    same = math.ceil(shared - 1e-9) if like > 0 else math.ceil(shared - 1e-9) - 1
    return " ".join(one), " ".join(one[:same + width - 1] + [f"{seed}v{i}" for i in range(n - same - width + 1)])


def likeness(one, two, width=5):
    a, b = (set(simhash.shingles(t.encode(), width).tolist()) for t in (one, two))
    return len(a & b) / len(a | b)


def test_deduplicate_keeps_texts_below_the_likeness(spark):
    pairs = [pair_of_texts(i, 200, like) for i, like in enumerate([-0.8] * 20 + [0.75] * 20 + [0.7] * 20 + [0.95] * 20)]
    assert all(likeness(*p) < 0.8 for p in pairs[:60])
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    rows += [(900, "q r s t u " * 200), (901, "q r s t u " * 200 + words(77, 30)), (902, " ".join(["z"] * 300 + ["a"])), (903, " ".join(["z"] * 9))]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert kept >= set(range(120)) | {900, 901, 902, 903}
    assert kept & set(range(120, 160)) == set(range(120, 160, 2))


def joined(labels, links):
    """The groups that links make of labels."""
    root = {x: x for x in labels}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {frozenset(x for x in root if find(x) == r) for r in map(find, root)}


@pytest.mark.parametrize("most", [2, 8, 30, 2048])
@pytest.mark.parametrize("groups", [60, 7, 2])
def test_groups_are_connected_as_by_all_near_pairs(spark, most, groups):
    """The same groups are connected whatever the length of a list and the sizes of the groups in it, by links that are near."""
    scheme = simhash.Scheme(4, 64, 2, [(0, 1), (1, 2), (3, 9)], labels=True)
    draw = np.random.default_rng(4)
    centres = draw.integers(0, 2**63, (3, 4), dtype=np.uint64)
    fps = np.stack([centres[i % 3] ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (4, 9)).astype(np.uint64), axis=1) for i in range(60)])
    label = [i % groups if i % 3 else 0 for i in range(60)]
    rows = [(f.tobytes() + i.to_bytes(8, "little"),) for f, i in zip(fps, label)]
    got = [(r.a, r.b) for r in simhash.near_links(spark.createDataFrame(rows, "fp binary"), scheme, most).collect()]
    number = {n: i for i, n in enumerate(scheme.node(fps).view(np.int64).tolist())}
    plain, want = simhash.Scheme(4, 64, 2, scheme.sets), set()
    for i in range(59):
        x, y = np.broadcast_to(fps[i], (60 - i - 1, 4)), fps[i + 1:]
        want |= {(i, int(j) + i + 1) for j in np.flatnonzero(plain.near(x, y) & (plain.first_set(x, y) >= 0))}
    assert want and {tuple(sorted((number[a], number[b]))) for a, b in got} <= want
    assert joined(label, [(label[number[a]], label[number[b]]) for a, b in got]) == joined(label, [(label[a], label[b]) for a, b in want])


@pytest.mark.parametrize("scheme", [simhash.SIMILAR[0], simhash.EXACT])
def test_a_pair_is_linked_alike_in_lists_of_any_length(spark, scheme):
    """Two entries that share two bytes and few bits, among entries that share their list and are far from them."""
    draw = np.random.default_rng(8)
    one = draw.integers(0, 2**63, scheme.lanes, dtype=np.uint64)
    results = {}
    for count in (2, 25, 3000):
        for flips in (3, 29):
            two = one.copy().view(np.uint8)
            free = [p for p in range(8 * scheme.lanes) if p not in scheme.sets[0]]
            two[free[:flips]] ^= np.uint8(1)
            others = draw.integers(0, 256, (count - 2, 8 * scheme.lanes)).astype(np.uint8)
            others[:, list(scheme.sets[0])] = one.view(np.uint8)[list(scheme.sets[0])]
            fps = [one.tobytes(), two.tobytes(), *(o.tobytes() for o in others)]
            rows = [(f + (i.to_bytes(8, "little") if scheme.labels else b""),) for i, f in enumerate(fps)]
            got = {frozenset((r.a, r.b)) for r in simhash.near_links(spark.createDataFrame(rows, "fp binary"), scheme, 1024).collect()}
            nodes = scheme.node(np.stack([one, two.view(np.uint64)])).view(np.int64).tolist()
            results.setdefault(flips, set()).add(frozenset(nodes) in got)
    assert all(len(v) == 1 for v in results.values()), results
    assert results[29] == {scheme is not simhash.EXACT} and results[3] == {True}


@pytest.mark.parametrize("most,piece", [(None, simhash.PIECE), (8, 5)])
def test_deduplicate_against_all_pairs(spark, monkeypatch, most, piece):
    """Families of texts of all likenesses, whole or cut into pieces: the rows that stay are those by all near pairs, compared one by one."""
    draw = np.random.default_rng(12)
    texts = []
    for f in range(4):
        base = words(f, 60, 10**6).split()
        for _ in range(14):
            t = list(base)
            for at in draw.integers(0, 60, draw.integers(0, 5)):
                t[at] = f"v{draw.integers(0, 10**6)}"
            texts.append(" ".join(t))
    texts += [None, "", "one two", "one two", *texts[:3]]
    rows = [(i * 7 % 97, t) for i, t in enumerate(texts)]
    sets = [np.unique(simhash.shingles((t or "").encode(), 5)) for t in texts]
    fps = np.stack([np.frombuffer(simhash._majority(h, 4), np.uint64) for h in sets])
    links = []
    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            alike = both * 5 >= (len(sets[i]) + len(sets[j]) - both) * 4
            told = simhash.SIMILAR[0].distance >= int(np.bitwise_count(fps[i] ^ fps[j]).sum()) and any(s.first_set(fps[i:i + 1], fps[j:j + 1])[0] >= 0 for s in simhash.SIMILAR)
            if alike and told:
                links.append((i, j))
    want = {min(rows[i][0] for i in group) for group in joined(range(len(texts)), links)}
    got = [r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", most=most, piece=piece).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("size", [200, 600])
def test_deduplicate_finds_isolated_pairs(spark, size):
    pairs = [pair_of_texts(f"{n}-{i}", size, like) for n, like in enumerate((0.8, 0.82, 0.85)) for i in range(100)]
    assert all(0.8 <= likeness(*p) < 0.86 for p in pairs)
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert kept >= set(range(0, 600, 2))
    for start in (0, 200, 400):  # each likeness: recall
        assert 1 - len(kept & set(range(start + 1, start + 200, 2))) / 100 >= 0.94, start


def brute_repeats(rows):
    texts = [(k, (t or "").encode()) for k, t in rows]
    order = lambda k: (k is not None, k or 0)
    first = {}
    for k, t in texts:
        for p in range(len(t) - 49):
            first[t[p:p + 50]] = min(first.get(t[p:p + 50], order(k)), order(k))
    out = []
    for k, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < order(k):
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((k, len(t), sum(gone), sum(1 for s in bytes(gone).split(b"\0") if s), kept))
    return Counter(out)


def test_suffix_repeats(spark, docs, none):
    got = suffixes.remove_repeats(docs, "doc_id", "text", part=4096).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats([r[:2] for r in corpus()])
    assert suffixes.remove_repeats(none, "doc_id", "text").count() == 0
    draw = np.random.default_rng(5)
    pool = ["ab" * 40, "a" * 130, words(9, 30), "é" * 70]
    rows = [(int(draw.integers(0, 15)), "".join(str(draw.integers(0, 9)) + pool[draw.integers(0, 4)][draw.integers(0, 20):draw.integers(30, 140)] for _ in range(5)), i) for i in range(30)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = suffixes.remove_repeats(clash, "doc_id", "text", part=1024).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats([r[:2] for r in rows])


@pytest.mark.parametrize("batches", [1, 2, 8])
def test_family_over_batches(spark, tmp_path, batches):
    """Batches against the stored levels lose what one run over all documents loses."""
    draw = np.random.default_rng(6)
    pool = ["ab" * 40, "a" * 130, words(9, 30), "é" * 70, words(19, 40)]
    rows = [(i, "".join(str(draw.integers(0, 9)) + pool[draw.integers(0, 5)][draw.integers(0, 20):draw.integers(30, 140)] for _ in range(5))) for i in range(40)]
    family = suffixes.Family(spark, f"file://{tmp_path}/family", buckets=5, part=1024, batch=64)
    got = Counter()
    for some in np.array_split(np.arange(40), batches):
        out = family.remove(spark.createDataFrame([rows[i] for i in some], "doc_id long, text string"), "doc_id", "text")
        got.update((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect())
    assert got == brute_repeats(rows)
    n, levels = family.levels()
    assert n == batches and len(levels) <= 1 + batches.bit_length()


def test_long_texts_are_read_by_pieces(spark):
    long = words(31, 120_000, 10**6)
    rows = [(1, long), (2, "x" + long[300_000:]), (3, long[:400_000] + "y")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {1: (0, 0), 2: (len(long) - 300_000, 1), 3: (400_000, 1)}


def test_levels_merge():
    draw = np.random.default_rng(1)
    keys, docs = draw.integers(0, 50, 700), draw.integers(0, 40, 700)
    least = {}
    for k, d in zip(keys, docs):
        least[k] = min(d, least.get(k, d))
    want = np.array([least[k] < d for k, d in zip(keys, docs)])
    assert (suffixes.had_earlier(keys, docs, 16) == want).all()
    wide = np.frombuffer(b"".join(int(k).to_bytes(suffixes.LENGTH, "big") for k in keys), suffixes._WINDOW)
    assert (suffixes.had_earlier(wide, docs, 16) == want).all()
    index = suffixes.Levels()
    for i in range(0, 640, 16):
        k, d, _ = suffixes.merged(keys[i:i + 16] * 1000 + np.arange(16), docs[i:i + 16])
        index.add(k, d)
    assert len(index.levels) <= 7 and all(len(a[0]) > len(b[0]) for a, b in zip(index.levels, index.levels[1:]))


def rolled(hashes):
    """A cyclic polynomial: each word's hash turned by its distance from the last one."""
    turn = lambda h, n: ((h << n) | (h >> (64 - n))) & (2**64 - 1) if n else h
    out = 0
    for i, h in enumerate(hashes):
        out ^= turn(h % 2**64, (len(hashes) - 1 - i) % 64)
    return out if out < 2**63 else out - 2**64


def brute_winnow(hashes, k=5, window=4):
    if not hashes:
        return []
    grams = [rolled(hashes[i:i + k]) for i in range(max(1, len(hashes) - k + 1))]
    want = []
    for i in range(max(1, len(grams) - window + 1)):
        some = grams[i:i + window]
        at = max(j for j in range(i, i + len(some)) if grams[j] == min(some))
        if not want or want[-1] != (at, grams[at]):
            want.append((at, grams[at]))
    return want


@pytest.mark.parametrize("k,window", [(5, 4), (4, 2), (3, 7), (6, 3)])
def test_winnowing(spark, docs, k, window):
    hash_ = lambda n: [r[0] for r in spark.createDataFrame([(w,) for w in n], "w string").select(F.xxhash64("w")).collect()] if n else []
    for text, split in [(words(2, 30), str.split), ("ab cd", str.split), ("x " * 20, str.split), ("日本語のテキストです。ア", lambda t: [c for c in t if c != "。"]),
                        ("q" * 40, list), ("", str.split), ("a b c d e f " + "z" * 32, str.split)]:
        got = spark.createDataFrame([(text,)], "t string").select(winnowing.winnow(F.col("t"), k, window)).first()[0]
        assert [(r.pos, r.hash) for r in got] == brute_winnow(hash_(split(text)), k, window), text


def test_winnowing_of_odd_texts(spark, docs):
    rows = docs.select("doc_id", winnowing.winnow(F.col("text")).alias("f"), F.col("text")).collect()
    assert [len(r.f) for r in rows if r.doc_id in (22, 23)] == [0, 0]
    repeated = next(r.f for r in rows if r.doc_id == 24)  # all k-grams are equal: the rightmost of each window
    assert [r.pos for r in repeated][:3] == [3, 4, 5]


def test_words_are_what_the_pattern_finds(spark):
    texts = ["", None, "a b-c", "日本語 text テキスト。ไทย abc", "q" * 33 + " " + "r" * 32, "é̀a 12", "x" * 40 + "日", "naïve café", " .. "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        winnowing.words_of(F.col("t")).alias("w"), F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit(winnowing.WORD), F.lit(0)).alias("p")).collect()
    assert [r.w for r in got] == [r.p for r in got]
    assert got[3].w == ["日", "本", "語", "text", "テ", "キ", "ス", "ト", "ไ", "ท", "ย", "abc"] and got[4].w == ["q"] * 33 + ["r" * 32]


def test_scripts_without_blanks_have_fingerprints(spark):
    text = "".join(chr(0x4E00 + int(x)) for x in np.random.default_rng(3).integers(0, 3000, 260))
    rows = spark.createDataFrame([(text, text[:247] + "x")], "a string, b string").select(
        winnowing.likeness(winnowing.winnow(F.col("a")), winnowing.winnow(F.col("b")))).first()
    assert rows[0] > 0.85


@pytest.mark.parametrize("coarse", [2, 1024])
def test_next_rows_of_repeated_keys(spark, monkeypatch, coarse):
    """A key and a null that hold most rows, in buckets inside buckets; columns of the operator's own names."""
    monkeypatch.setattr(winnowing, "_COARSE", coarse)
    rows = [(7 if i % 3 else i, f"t{i % 90}", i) for i in range(120)] + [(None, f"n{i}", i) for i in range(60)]
    frame = spark.createDataFrame(rows, "k long, text string, _h int").withColumn("_bucket", F.lit("b")).withColumn("fb", F.lit(1))
    got = winnowing.with_next(frame, "k", ["text", "k"], each=64).collect()
    h = {r.text: r[1] for r in frame.select("text", F.xxhash64("text")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]))
    want = Counter((a[0], a[1], b[0], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    assert Counter((r.k, r.text, r.next_k, r.next_text) for r in got) == want
    assert set(got[0].asDict()) == {"k", "text", "_h", "_bucket", "fb", "next_text", "next_k"}


def test_next_rows(spark):
    rows = [(i * 7 % 50, f"t{i}", i) for i in range(50)] + [(None, "none", 1)]
    got = winnowing.with_next(spark.createDataFrame(rows, "k long, text string, next_x int"), "k", ["text"], each=16).collect()
    order = [r[1] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert {r.text: r.next_text for r in got} == dict(zip(order, order[1:] + order[:1]))
    assert winnowing.with_next(spark.createDataFrame([(1, "a")], "k long, text string"), "k", ["text"]).first().next_text == "a"
    assert winnowing.with_next(spark.createDataFrame([], "k long, text string"), "k", ["text"]).count() == 0


@pytest.mark.parametrize("same", [
    lambda t: t.upper(), lambda t: t.replace("license", "licence"), lambda t: "  " + t.replace(", ", ",\n\t"),
    lambda t: "// Copyright 2020 Someone, Ltd.\n" + t.replace(",", ";"),
])
def test_licences(spark, same):
    name, text = licences.known_texts()[0]
    rows = [(1, same(text), 5), (2, text + " more", 5), (3, None, 5), (4, "", 5), (5, "(c) 2020 me", 5)]
    got = {r.id: (r.licence, r.canonical_sha256) for r in licences.scan(spark.createDataFrame(rows, "id int, t string, licence int"), "t").collect()}
    assert got[1][0] == name
    assert [got[i][0] for i in (2, 3, 4, 5)] == [None] * 4 and got[3][1] is got[4][1] is got[5][1] is None


@pytest.mark.parametrize("header", ["", "Copyright (c) 2020 Someone\n\n", "Copyright 2019, 2020 The Authors.\nAll rights reserved.\n\n", "Copyright Someone Ltd.\r\n"])
def test_wrapped_licences(spark, header):
    import textwrap
    rows = []
    for name, text in licences.known_texts():
        body = "\n\n".join(p for p in text.split("\n\n") if not p.strip().startswith("Copyright (c)"))
        rows += [(name, header + "\n\n".join(textwrap.fill(p, width) for p in body.split("\n\n"))) for width in range(30, 81, 5)]
    wrapped = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and"
    isc = next(t for n, t in licences.known_texts() if n == "ISC").split("<owner>")[1]
    rows += [("ISC", header + isc.replace(wrapped.replace("\n", " "), wrapped)), ("ISC", "Copyright (c) 2020 Someone " + " ".join(isc.split()))]
    got = licences.scan(spark.createDataFrame(rows, "want string, t string"), "t").collect()
    assert len(got) == len(rows) and [(r.want, r.t) for r in got if r.licence != r.want] == []


def test_known_digests(spark):
    """The digests of the longer licences, where this machine has their texts."""
    import os
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(n, open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read()) for n, f in files.items() if os.path.exists(f"/usr/share/common-licenses/{f}")]
    rows += [(n, t.replace("\n", "\r\n") + "\n") for n, t in rows]
    got = licences.scan(spark.createDataFrame(rows, "want string, t string"), "t").collect()
    assert [(r.want, r.licence) for r in got if r.want != r.licence] == []


def test_licences_of_empty_repeated_and_long_texts(spark, none):
    assert licences.scan(none, "text").count() == 0
    name, text = licences.known_texts()[0]
    rows = [(1, text), (1, text), (2, text * 300)]
    got = licences.scan(spark.createDataFrame(rows, "_known long, text string"), "text").collect()
    assert Counter((r._known, r.licence) for r in got) == {(1, name): 2, (2, None): 1}


def encoder():
    ranks, pattern = bpe.vocabulary()
    return ranks, pattern, tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, none):
    ranks, pattern, known = encoder()
    got = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1)), "text", ranks, pattern), "ids", ranks).collect()
    want = Counter((k, tuple(known.encode_ordinary(t or ""))) for k, t, *_ in corpus())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert Counter((r.doc_id, bytes(r.decoded)) for r in got) == Counter((k, (t or "").encode()) for k, t, *_ in corpus())
    assert bpe.encode(none, "text", ranks, pattern).count() == 0


@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0'sS²½×÷ªµ09aZéſ　")), max_size=40))
@settings(max_examples=400, deadline=None)
def test_splitter(text):
    ranks, pattern, known = encoder_once()
    split = bpe.Splitter(pattern)
    assert split(text) == split.general.findall(text)
    assert [i for w in split(text) for i in known._encode_single_piece(w.encode())] == known.encode_ordinary(text)


_ONCE = []


def encoder_once():
    if not _ONCE:
        _ONCE.append(encoder())
    return _ONCE[0]


def test_language_id(spark, none):
    draw = np.random.default_rng(0)
    stems = {"aa": "the and of with this that from where".split(), "bb": "der die und nicht mit einer auch wenn".split()}
    rows = [(i, " ".join(draw.choice(stems[k], 30)), k) for i in range(120) for k in stems]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train, "text", "lang", ~langid.held_out("doc_id", 5, 0))
    got = langid.predict(train.withColumn("score", F.lit(9)), "text", model).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the")], "doc_id long, text string")
    assert [r.lang_pred for r in sorted(langid.predict(odd, "text", model).collect())] == ["und", "und", "und", "aa"]
    empty = langid.fit(none, "text", "lang", F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, "text", empty).collect()} == {"und"}


@pytest.mark.parametrize("languages", [3, 70])
def test_shares_against_plain_filters(languages):
    """Shares and predictions as counted from one Bloom filter per language, for more languages than a slot holds bits too."""
    draw = np.random.default_rng(9)
    letters = [chr(97 + i) for i in range(26)]
    words_of = [["".join(draw.choice(letters, 6)) for _ in range(12)] for _ in range(languages)]
    samples = {f"l{i:02}": [" ".join(draw.choice(w, 40)) for _ in range(3)] for i, w in enumerate(words_of)}
    model = langid.LanguageFilter.of(samples)
    texts = [" ".join(draw.choice(words_of[i], 30)) for i in range(languages)] + [" ".join([*words_of[0][:4], *words_of[1][:3]])]
    names, scores = model.predict(texts)
    grams_of = lambda t: [b[i:i + 4] for b in [langid._bytes(t)] for i in range(len(b) - 3) if b[i:i + 2] != b"  "]
    number = lambda g: int.from_bytes(g, "little")
    slots_of = lambda g: [int(s[0]) for s in langid._slots(np.array([number(g)], np.uint32))]
    counts = {k: Counter(g for t in ts for g in grams_of(t)) for k, ts in samples.items()}
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    most = defaultdict(float)
    for r in rate.values():
        for g, x in r.items():
            most[g] = max(most[g], x)
    filters = {k: {s for g, n in c.items() if n >= langid.LEAST and rate[k][g] >= langid.COMMON * most[g] for s in slots_of(g)} for k, c in counts.items()}
    for t, name, score in zip(texts, names, scores):
        found = {}
        for k, f in filters.items():
            grams, false = grams_of(t), (len(f) / langid.SLOTS) ** langid.HASHES
            share = sum(all(s in f for s in slots_of(g)) for g in grams) / len(grams)
            found[k] = min(1, max(0, (share - false) / (1 - false)))
        best = max(sorted(found), key=lambda k: round(found[k], 12))
        assert name == best and abs(found[best] - score) < 1e-9


def test_language_of_repeated_rows_and_ties(spark):
    model = langid.LanguageFilter.of({"b": ["same words here same words here"], "a": ["same words here same words here"]})
    rows = spark.createDataFrame([(1, "same words"), (1, "same words"), (2, None)], "doc_id long, text string")
    got = langid.predict(rows, "text", model).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in got) == {(1, "a"): 2, (2, "und"): 1}


def test_filter_contains_what_it_learnt():
    model = langid.LanguageFilter.of({"a": ["abcdefgh abcdefgh"], "b": ["zyxwvu zyxwvu"]})
    assert model.predict(["abcdefgh", "zyxwvu"])[0] == ["a", "b"]


def test_toxicity(spark):
    draw = np.random.default_rng(2)
    texts = []
    for i in range(400):
        t = list(draw.choice([f"w{x}" for x in range(300)], 40))
        bad = i % 4 == 0
        if bad:
            t[draw.integers(0, 40)] = f"vile{draw.integers(0, 50)}"
        texts.append((i, " ".join(t), int(bad)))
    texts = [(i, t.translate(str.maketrans("0123456789", "abcdefghij")), y) for i, t, y in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string, y int")
    model = toxicity.fit(docs, "text", "doc_id", docs.select("doc_id", "y"), "y", ~langid.held_out("doc_id", 4, 2))
    got = toxicity.score(docs, "text", model).collect()
    assert np.mean([(r.score >= toxicity.THRESHOLD) == r.y for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0)], "doc_id long, text string, score double")
    a, b = (r.score for r in toxicity.score(odd, "text", model).collect())
    assert a == b and 0 <= a < toxicity.THRESHOLD


def test_scores_do_not_depend_on_the_batch():
    model = toxicity.Classifier()
    texts = [words(i, n) for i, n in enumerate((0, 1, 2, 50, 900))]
    alone = [toxicity.Scorer(model).scores([t])[0] for t in texts]
    assert np.allclose(alone, toxicity.Scorer(model).scores(texts), atol=1e-6)


@pytest.mark.parametrize("query_bytes", [700, 1 << 20])
def test_top_k(docs, none, query_bytes):
    rows = [(k, t) for k, t, *_ in corpus()]
    tokens = [(t or "").lower().encode().translate(search._SPACED).split() for _, t in rows]
    df, n = Counter(w for t in tokens for w in set(t)), len(rows)
    mean = sum(map(len, tokens)) / n
    got = defaultdict(list)
    for r in search.top_k(docs, "doc_id", "text", F.col("doc_id") % 5 == 0, k=4, shard_bytes=6000, query_bytes=query_bytes).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score, 6)))
    for q in sorted({k for k, _ in rows if k is not None and k % 5 == 0}):
        query = {w for (k, _), t in zip(rows, tokens) if k == q for w in t}
        hits = []
        for (k, _), t in zip(rows, tokens):
            tf = Counter(t)
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in query if w in tf)
            if s > 0:
                hits.append((-round(s, 9), k is None, k, round(s, 6)))
        assert got[q] == [(h[2], h[3]) for h in sorted(hits, key=lambda h: h[:3])[:4]]
    assert search.top_k(none, "doc_id", "text", F.lit(True)).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(i * 37 % 4099, (i + 1) * 37 % 4099) for i in range(4098)]
    assert {r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()} == {0}


def test_scratch_belongs_to_its_owner(spark):
    with common.owned("one"):
        first = common.stored(spark.range(3), "x")
    with common.owned("two"):
        second = common.bucketed(spark.range(4), "id", 2, "y")
    common.clear_scratch(spark, "one")
    assert second.count() == 4
    with pytest.raises(Exception):
        first.count()
    name = next(n for kind, n in common._SCRATCH["two"] if kind == "table")
    common.clear_scratch(spark, "two")
    assert not spark.catalog.tableExists(name)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline

    for start in (docs, none):
        rows = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, "")
            assert out.columns == corpus_pipeline.COLUMNS
            rows = spark.createDataFrame(out.collect(), DOCS)
        done = corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()
        assert len(done) == rows.count() and all(r.round_trip for r in done)


def test_tokens_tell_the_order_of_the_mixture(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"text {i} of {words(i, 20)}", "en", "s" + str(min(i % 7, 2)), 1) for i in range(300)]
    start = spark.createDataFrame(rows, DOCS)
    want = [r.doc_id for r in mixing.mix(start, "source", "doc_id").orderBy("mix_slot", "mix_place").collect()]
    out = corpus_pipeline.mixed_sources(spark, start, "")
    out.write.option("maxRecordsPerFile", 9).parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), "").select("place", "doc_id").collect()
    assert [tuple(r) for r in sorted(got)] == list(enumerate(want))


def test_repeats_keep_whole_characters(spark):
    cut = spark.createDataFrame([(bytearray("aé".encode()[:2] + b"b"),)], "kept binary").select(suffixes.whole_characters(F.col("kept"))).first()[0]
    assert cut == "ab"
    assert hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(("cells", "kept"), [(search.ROW_CELLS, search.KEPT), (0, search.KEPT), (search.ROW_CELLS, 20)])
def test_search_sums_few_documents_exactly(monkeypatch, cells, kept):
    """Most documents of a block that is read are passed over by a sum in single precision, which loses no hit; without room for full rows too."""
    monkeypatch.setattr(search, "ROW_CELLS", cells)
    monkeypatch.setattr(search, "KEPT", kept)
    rng = np.random.default_rng(7)
    texts = [rng.zipf(1.2, int(rng.integers(0, 120))) % 3000 for _ in range(2000)]
    texts[500:530] = [texts[499]] * 30
    found = [t.astype(np.uint64) for t in texts]
    ids = [None if i in (501, 502) else 7919 * i % 10_007 for i in range(len(found))]
    counts = np.zeros((len(found), 3000))
    for i, t in enumerate(found):
        np.add.at(counts[i], t.astype(int), 1)
    length, df = counts.sum(1), (counts > 0).sum(0)
    mean = length.mean()
    weight = np.log1p((len(found) - df + 0.5) / (df + 0.5))
    impact = counts * (search.K1 + 1) / (counts + search.K1 * (1 - search.B + search.B * length[:, None] / mean))
    asks = [*range(0, 2000, 20), 499]
    own = [np.unique(found[i]) for i in asks]
    queries, best, added = search.Queries(asks, own, [df[o.astype(int)] for o in own], len(found)), search.Best(len(asks), 10), []
    add = search.Best.add
    monkeypatch.setattr(search.Best, "add", lambda self, at, score, *rest: added.append(np.count_nonzero(score)) or add(self, at, score, *rest))
    read = sum(search.Index(search.Postings(ids[a:a + 500], found[a:a + 500]), mean).search(queries, best) for a in range(0, 2000, 500))
    for n, ask in enumerate(queries.ids):
        score = np.round(((counts[ask] > 0) * weight) @ impact.T, search.DECIMALS)
        hits = sorted((-s, i is None, i or 0) for s, i in zip(score, ids) if s > 0)[:10]
        got = [(-s, bool(o), int(i)) for s, o, i in zip(best.score[n], best.none[n], best.ids[n]) if s > 0]
        assert [h[1:] for h in got] == [h[1:] for h in hits] and np.allclose([h[0] for h in got], [h[0] for h in hits])
    assert sum(added) < read * search.BLOCK / 5
