"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two fingerprints that differ in few bits agree in many of their bytes. Posting lists of single
bytes would each hold a 256th of the corpus, so lists are intersected before pairs are formed:
the index is keyed by sets of positions and their bytes. Per candidate pair the shared
positional bytes are tallied, pairs below the least number go, and the bits of the rest are
compared.

``EXACT``: 64 bits, four of which may differ. Then at least four of eight bytes are shared,
and of the twenty triples of positions in the index every four positions contain one: every
pair is found.
``SIMILAR``: 256 bits, for likeness 0.8 of the shingles. So many bits may differ there that
no number of shared bytes is certain; a pair of likeness 0.8 shares eight of 32 on average,
two are asked for, and 128 pairs of positions are indexed, in two steps. Every list links what its near pairs
connect, with as many links as there are entries at most; what the first step has connected, the
second does not link again. The links make families, and inside a family the shingles of near pairs are
compared, until they are connected. So neither lists nor families are paired out: rows
grow with the entries, not with their pairs. README has the measured recall.

Equal fingerprints are one entry. A list with more entries than ``most`` is not worked on in one
place. For ``EXACT`` it is split by
five blocks of the free bits, one of which a near pair must share, until 17 free bits bound
the list. For ``SIMILAR`` it is cut into pieces, and every two pieces that hold
two groups meet in a task of their own; large families are cut in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, mix64, small_batches, stored, tidy

#: Entries of a list from which on it is split or cut; entries up to which pairs are formed by shifting whole batches.
LIST, LONG_LIST, SHIFTS = 2048, 1 << 14, 24
#: Texts of a piece of a family, and bytes of their shingles' hashes.
PIECE, PIECE_BYTES = 4096, 1 << 24


class Scheme:
    """Fingerprints of ``lanes`` times 64 bits, the bits that may differ, the bytes that must be
    shared, the sets of positions that key the index, and how often lists are split. With ``labels``,
    a word behind the lanes tells a group, and only links between groups are told."""

    def __init__(self, lanes: int, distance: int, shared: int, sets: list[tuple[int, ...]], splits: int = 0, labels: bool = False):
        self.lanes, self.distance, self.shared, self.sets, self.splits = lanes, distance, shared, sets, splits
        self.labels, self.words = labels, lanes + labels
        self.base = np.stack([_bytes_mask(s, self.words) for s in sets])

    def children(self, mask: np.ndarray) -> np.ndarray:
        """A mask with each of the five blocks of free bits that it can be extended by."""
        free = [b for b in range(64) if not int(mask[0]) >> b & 1]
        return np.stack([mask | np.array([sum(1 << int(b) for b in block)], np.uint64) for block in np.array_split(free, 5)])

    def mask(self, name: int, level: int) -> np.ndarray:
        return self.base[name] if level == 0 else self.children(self.mask(name >> 6, level - 1))[name & 63]

    def node(self, fps: np.ndarray) -> np.ndarray:
        """A number for a fingerprint: itself, or a hash of its lanes."""
        return fps[:, 0] if self.lanes == 1 else _chain(fps[:, :self.lanes])

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Tally the shared positional bytes, then compare the bits of pairs with enough of them."""
        differ = (x ^ y)[:, :self.lanes]
        out = (np.ascontiguousarray(differ).view(np.uint8).reshape(len(x), 8 * self.lanes) == 0).sum(1) >= self.shared
        out[out] = np.bitwise_count(differ[out]).sum(1, dtype=np.int64) <= self.distance
        return out & (x[:, -1] != y[..., -1]) if self.labels else out

    def first_set(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first set of positions that pairs share."""
        same = np.ascontiguousarray((x ^ y)[:, :self.lanes]).view(np.uint8).reshape(len(x), 8 * self.lanes) == 0
        out = np.full(len(x), -1)
        for i in reversed(range(len(self.sets))):
            out[same[:, self.sets[i]].all(1)] = i
        return out


def _bytes_mask(positions: tuple[int, ...], lanes: int) -> np.ndarray:
    out = np.zeros(8 * lanes, np.uint8)
    out[list(positions)] = 0xFF
    return out.view(np.uint64)


def _triples() -> list[tuple[int, ...]]:
    """Twenty triples of byte positions: inside a group, or two of a group and one of the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [g for g in groups if len(g) == 3]
    for i, g in enumerate(groups):
        out += [(*two, one) for two in combinations(g, 2) for one in groups[(i + 1) % 3]]
    return out


def _rounds(positions: int, rounds: int) -> list[tuple[int, ...]]:
    """Pairs of positions, each position once in a round (a round-robin tournament's)."""
    ring = list(range(1, positions))
    out = []
    for r in range(rounds):
        turned = [0, *ring[r:], *ring[:r]]
        out += [tuple(sorted((turned[i], turned[-1 - i]))) for i in range(positions // 2)]
    return out


EXACT = Scheme(1, 4, 4, _triples(), 4)
#: Fingerprints of likeness 0.8 differ in 39 of 256 bits on average, give or take 6 (of four shingles and five, 48). The first
#: step has each position once, the second 112 more pairs of them.
SIMILAR = [Scheme(4, 64, 2, _rounds(32, 8)[:16], labels=True), Scheme(4, 64, 2, _rounds(32, 8)[16:], labels=True)]


def _chain(fps: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for lane in range(fps.shape[1]):
        out = mix64(out ^ fps[:, lane]) + np.uint64(0x9E3779B97F4A7C15)
    return out


def shingles(data: bytes, width: int) -> np.ndarray:
    """The shingles of a text as hashes: A-Z lowered, words between ASCII blanks, XXH64 with seed
    42 of each run of ``width`` words joined by one blank (of all words, if fewer). No words: none."""
    words = data.lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    return np.array([digest(joined[a:b], 42) for a, b in zip([0, *ends[:-1].tolist()], (ends - 1).tolist()[width - 1:])], np.uint64)


def fingerprint(data: bytes, width: int, lanes: int = 1) -> bytes:
    """The fingerprint of a text: a bit is set where over half the hashes of its shingles have
    it. Further lanes mix the hash anew. No words: zero."""
    return _majority(shingles(data, width), lanes)


def _majority(hashes: np.ndarray, lanes: int) -> bytes:
    if not len(hashes):
        return bytes(8 * lanes)
    out = []
    for lane in range(lanes):
        mixed = hashes if lane == 0 else mix64(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))
        ones = np.zeros(64, np.int64)
        for i in range(0, len(mixed), 1 << 16):
            ones += np.unpackbits(mixed[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(mixed), bitorder="little").tobytes())
    return b"".join(out)


def _fps(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, lanes)


def _binary(fps: np.ndarray) -> pa.Array:
    width = 8 * fps.shape[1]
    data = np.ascontiguousarray(fps).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(fps), [None, pa.py_buffer(np.arange(0, len(data) + 1, width, dtype=np.int32)), pa.py_buffer(data)])


def fingerprints(docs: DataFrame, text: str, width: int, scheme: Scheme = EXACT, out: str = "simhash", node: str = "node") -> DataFrame:
    """``docs`` with the fingerprint of each whole text (null: as empty) as bytes, and its
    number. Every row and every other column stays; columns of the names ``out`` and ``node``
    are replaced. No shuffle."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out, node)
    carried = docs.withColumn(text, F.col(text).cast("binary"))
    place = carried.columns.index(text)
    schema = T.StructType([*carried.schema.fields, T.StructField(out, T.BinaryType()), T.StructField(node, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", width, scheme.lanes) for x in part.column(place)]
                fps = np.frombuffer(b"".join(found), np.uint64).reshape(-1, scheme.lanes)
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(fps), pa.array(scheme.node(fps).view(np.int64))], names=schema.names)
        tidy()

    return carried.mapInArrow(run, schema).withColumn(text, F.col(text).cast("string"))


_ENTRY = T.StructType([T.StructField("key", T.LongType()), T.StructField("mask", T.LongType()), T.StructField("fp", T.BinaryType())])
_FOUND = T.StructType([*_ENTRY.fields, T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _entries(fps: np.ndarray, names: np.ndarray, masks: np.ndarray) -> list[pa.Array]:
    """Index entries of fingerprints under each of masks."""
    keys = [_chain(fps & m) ^ _chain(m[None] + np.uint64(1)) for m in masks]
    return [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(names, len(fps))), _binary(np.tile(fps, (len(masks), 1)))]


def _index(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.arange(len(scheme.sets))
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield pa.RecordBatch.from_arrays(_entries(_fps(batch.column(0).slice(i, 1000), scheme.words), names, scheme.base), names=_ENTRY.names)
        tidy()

    return run


def _forest(fps: np.ndarray, scheme: Scheme, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the entries of a list, or their groups, as all near pairs would, of ``fps`` and ``others`` if these are given:
    each entry is linked to one of each group that it is near to and not connected with yet."""
    every = fps if others is None else np.concatenate([fps, others])
    group = np.unique(every[:, -1], return_inverse=True)[1] if scheme.labels else np.arange(len(every))
    one, two = [], []
    for i in range(len(fps)):
        start = i + 1 if others is None else len(fps)
        at = np.flatnonzero(group[start:] != group[i]) + start
        if not len(at):
            if (group == group[0]).all():
                break
            continue
        hit = at[np.bitwise_count((every[at] ^ every[i])[:, :scheme.lanes]).sum(1, dtype=np.int64) <= scheme.distance]
        hit = hit[scheme.near(every[hit], every[i])]
        if len(hit):
            met, first = np.unique(group[hit], return_index=True)
            one.append(np.full(len(first), i))
            two.append(hit[first])
            group[np.isin(group, met)] = group[i]
    none = np.zeros(0, np.int64)
    return every[np.concatenate([none, *one])], every[np.concatenate([none, *two])]


def _link_rows(scheme: Scheme, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(x), k) for k in (pa.int64(), pa.int64(), pa.binary())]
    return pa.RecordBatch.from_arrays([*none, *(pa.array(scheme.node(v).view(np.int64)) for v in (x, y))], names=_FOUND.names)


def _entry_rows(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), pa.int64()) for _ in range(2))], names=_FOUND.names)


def _search(scheme: Scheme, level: int, most: int):
    """Over entries sorted by key: links, and the entries of lists that are too long to be worked on here."""

    def beyond(fps: np.ndarray, name: int) -> Iterator[pa.RecordBatch]:
        """Entries of a list that is too long, as they go on: split, or as they are."""
        if scheme.labels:
            for i in range(0, len(fps), 1000):
                yield _entry_rows(_entries(fps[i:i + 1000], np.array([name]), scheme.base[name:name + 1]))
            return
        masks = scheme.children(scheme.mask(name, level))
        names = (name << 6) + np.arange(len(masks))
        for i in range(0, len(fps), 1000):
            yield _entry_rows(_entries(fps[i:i + 1000], names, masks))

    def whole(key: np.ndarray, mask: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lists that are there from end to end."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        for k in np.flatnonzero(sizes > SHIFTS):
            own = fps[starts[k]:starts[k] + sizes[k]]
            if len(own) <= most or not scheme.labels and level == scheme.splits:
                one, two = _forest(own, scheme)
                if len(one):
                    yield _link_rows(scheme, one, two)
            else:
                yield from beyond(own, int(mask[starts[k]]))
        small = np.repeat((sizes <= SHIFTS) & (sizes > 1), sizes)
        key, mask, fps = key[small], mask[small], fps[small]
        for d in range(1, min(SHIFTS, len(key))):
            at = np.flatnonzero(key[d:] == key[:-d])
            if not len(at):
                break
            for i in range(0, len(at), 1 << 16):
                one = at[i:i + (1 << 16)]
                one = one[scheme.near(fps[one], fps[one + d])]
                if level == 0 and len(one):  # a pair that shares many sets is told once
                    one = one[scheme.first_set(fps[one], fps[one + d]) == mask[one]]
                if len(one):
                    yield _link_rows(scheme, fps[one], fps[one + d])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, scheme.words), np.uint64)]
        held, long_key = none, None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), _fps(batch.column(2), scheme.words)]
            if long_key is not None:  # the rest of a long list
                end = int(np.searchsorted(new[0], long_key, "right"))
                if end:
                    yield from beyond(new[2][:end], int(new[1][0]))
                new = [n[end:] for n in new]
                if not len(new[0]):
                    continue
                long_key = None
            now = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last:
                yield from whole(*(x[:last] for x in now))
            held = [x[last:] for x in now]
            if len(held[0]) > most and (scheme.labels or level < scheme.splits):
                yield from beyond(held[2], int(held[1][0]))
                held, long_key = none, held[0][0]
        if len(held[0]):
            yield from whole(*held)
        tidy()

    return run


def _meetings(columns: list[int], told):
    """Over rows sorted by the first ``columns``: ``told`` of each group of rows that agree in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            keys = [now.column(c).to_numpy() for c in columns]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            a = 0
            for z in change.tolist():
                yield from told(now.slice(a, z - a).combine_chunks())
                a = z
            held = now.slice(a)
        if held is not None and held.num_rows:
            yield from told(held.combine_chunks())
        tidy()

    return run


def _pair_rows(one: np.ndarray, two: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(one):
        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["a", "b"])


def _met(scheme: Scheme):
    """Links of two pieces of a long list (``lo``, ``hi``), or of one."""

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        fps = _fps(rows.column("fp"), scheme.words)
        lo, hi, unit = (rows.column(c).to_numpy() for c in ("lo", "hi", "unit"))
        one, two = _forest(fps[unit == lo], scheme, None if lo[0] == hi[0] else fps[unit != lo])
        yield from _pair_rows(scheme.node(one).view(np.int64), scheme.node(two).view(np.int64))

    return told


def _long_lists(rest: DataFrame, scheme: Scheme, most: int) -> DataFrame:
    """The links of long lists: their entries, cut into pieces of about half of ``most``, each two of which meet in one task.
    Small groups share pieces; a group that fills pieces of its own needs no links among these."""
    half = max(1, most // 2)
    entries = rest.withColumn("label", F.substring("fp", 8 * scheme.lanes + 1, 8))
    counts = entries.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") > half
    lists = counts.groupBy("key").agg(
        F.sum(F.when(~large, F.col("n"))).alias("_small"),
        F.sort_array(F.collect_list(F.when(large, F.struct("label", F.expr(f"cast(ceil(n / {half}) as int)").alias("pieces"))))).alias("_large"))
    at = F.aggregate("_large", F.struct(F.lit(0).alias("end"), F.lit(-1).alias("start"), F.lit(0).alias("pieces")), lambda s, g: F.struct(
        (s["end"] + g["pieces"]).alias("end"), F.when(g["label"] == F.col("label"), s["end"]).otherwise(s["start"]).alias("start"),
        F.when(g["label"] == F.col("label"), g["pieces"]).otherwise(s["pieces"]).alias("pieces")))
    own = F.when(F.col("_at.start") >= 0, F.col("_at.start") + F.pmod(F.xxhash64("fp"), F.col("_at.pieces")).cast("int")).otherwise(
        F.col("_at.end") + F.pmod(F.xxhash64("label"), F.greatest(F.col("_shared"), F.lit(1))).cast("int"))
    placed = entries.join(lists, "key").withColumn("_at", at).withColumn("_shared", F.expr(f"cast(ceil(coalesce(_small, 0) / {half}) as int)"))
    placed = placed.withColumn("unit", own).withColumn("_all", F.col("_at.end") + F.col("_shared"))
    partners = F.filter(F.sequence(F.lit(0), F.col("_all") - 1), lambda u: (F.col("_at.start") < 0) | (u < F.col("_at.start")) | (u >= F.col("_at.start") + F.col("_at.pieces")))
    met = placed.select("key", "fp", "unit", F.explode(partners).alias("_u")).select(
        "key", F.least("unit", "_u").alias("lo"), F.greatest("unit", "_u").alias("hi"), "unit", "fp")
    return met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_meetings([0, 1, 2], _met(scheme)), "a long, b long")


def near_links(fps: DataFrame, scheme: Scheme = EXACT, most: int | None = None) -> DataFrame:
    """Links (a, b) between the numbers of distinct fingerprints: such that they connect them, or with labels their groups, as all
    near pairs would that share a set of the index. The length of lists (``most``) does not change what is connected, only where it is
    worked on. ``fps`` has one column of fingerprints (and labels, in the last eight bytes); its name is free."""
    most = most or (LONG_LIST if scheme.labels else LIST)
    entries = fps.mapInArrow(_index(scheme), _ENTRY)
    out = None
    for level in range(scheme.splits + 1):
        dealt = entries.repartition("key").sortWithinPartitions("key")
        found = stored(dealt.mapInArrow(_search(scheme, level, most), _FOUND), f"near{level}")
        links = found.where("a is not null").select("a", "b")
        out = links if out is None else out.union(links)
        entries = found.where("a is null").select(_ENTRY.names)
        if scheme.labels and not entries.isEmpty():
            return out.union(_long_lists(entries, scheme, most))
        if level == scheme.splits or entries.isEmpty():
            return out
    return out


def near_components(docs: DataFrame, key: str, fp: str, node: str, scheme: Scheme = EXACT, most: int | None = None) -> DataFrame:
    """A row per fingerprint: ``node``, its number, ``root``, a number that stands for its
    component, and ``component_id``, the smallest ``key`` that is reachable over near
    fingerprints. Null keys are skipped; a component of null keys alone has a null id."""
    own = stored(docs.groupBy(node).agg(F.min(key).alias("_least"), F.first(fp).alias("_fp")), "fingerprints")
    roots = components(near_links(own.select("_fp"), scheme, most)).toDF("_n", "_r")
    labelled = own.join(roots, own[node] == roots["_n"], "left").select(node, "_least", F.coalesce("_r", node).alias("root"))
    least = labelled.groupBy("root").agg(F.min("_least").alias("component_id"))
    return labelled.join(least, "root").select(F.col(node).alias("node"), "root", "component_id")


#: The likeness of near copies: shingles in common, of the shingles of both, in parts.
LIKE = (4, 5)


def _sketches(docs: DataFrame, key: str, text: str, width: int, scheme: Scheme) -> DataFrame:
    """Per row its key, ``_th``, a hash of its text, ``_set``, a hash of the set of its shingles,
    ``_size``, how many these are, and the set's fingerprint ``_fp`` with its number ``_node``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_th"), F.col(text).cast("binary").alias("_t"))
    longs = [T.StructField(n, T.LongType()) for n in ("_set", "_size", "_node")]
    schema = T.StructType([*rows.schema.fields[:2], *longs, T.StructField("_fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, found = [], [], []
            for x in batch.column(2):
                hashes = np.unique(shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", width))
                sets.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42))
                sizes.append(len(hashes))
                found.append(_majority(hashes, scheme.lanes))
            fps = np.frombuffer(b"".join(found), np.uint64).reshape(-1, scheme.lanes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 pa.array(scheme.node(fps).view(np.int64)), _binary(fps)], names=schema.names)
        tidy()

    return rows.mapInArrow(run, schema)


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``_set`` and its hashes, from ``_set`` and a text (bytes) that has it."""
    schema = T.StructType([T.StructField("_set", T.LongType()), T.StructField("_hashes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", width)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=schema.names)
        tidy()

    return texts.mapInArrow(run, schema)


def _alike(schemes: list[Scheme]):
    """Of the texts of a family, or of two pieces of one: links that connect them as all pairs would that are near, share a set of the
    index, and have likeness ``LIKE`` and more."""

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lo, hi, unit, sets = (rows.column(c).to_numpy() for c in ("_lo", "_hi", "_unit", "_set"))
        fps = _fps(rows.column("_fp"), schemes[0].lanes)
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("_hashes")]
        size = np.array([len(h) for h in hashes])
        ends = np.cumsum(size)
        known, ids = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        mark, group, inner = np.zeros(len(known), bool), np.arange(len(sets)), lo[0] == hi[0]
        ours = np.arange(len(sets)) if inner else np.flatnonzero(unit == lo)
        theirs = ours if inner else np.flatnonzero(unit != lo)
        one, two = [], []
        for n, i in enumerate(ours):
            at = theirs[n + 1:] if inner else theirs
            at = at[group[at] != group[i]]
            at = at[np.minimum(size[at], size[i]) * LIKE[1] >= np.maximum(size[at], size[i]) * LIKE[0]]
            if len(at):
                at = at[np.bitwise_count(fps[at] ^ fps[i]).sum(1, dtype=np.int64) <= schemes[0].distance]
                at = at[np.any([s.first_set(fps[at], fps[i][None]) >= 0 for s in schemes], axis=0)]
            if not len(at):
                continue
            mark[ids[ends[i] - size[i]:ends[i]]] = True
            for a in range(0, len(at), 512):
                some = at[a:a + 512]
                n_some = size[some]
                place = np.repeat(ends[some] - n_some - (np.cumsum(n_some) - n_some), n_some) + np.arange(n_some.sum())
                both = np.zeros(len(some), np.int64)
                both[n_some > 0] = np.add.reduceat(mark[ids[place]], (np.cumsum(n_some) - n_some)[n_some > 0], dtype=np.int64) if len(place) else 0
                hit = some[both * LIKE[1] >= (size[i] + n_some - both) * LIKE[0]]
                if len(hit):
                    met, first = np.unique(group[hit], return_index=True)
                    one += [i] * len(first)
                    two += hit[first].tolist()
                    group[np.isin(group, met)] = group[i]
            mark[ids[ends[i] - size[i]:ends[i]]] = False
        yield from _pair_rows(sets[one] if one else sets[:0], sets[two] if two else sets[:0])

    return told


def verified_links(docs: DataFrame, marked: DataFrame, key: str, text: str, width: int, schemes: list[Scheme], most: int | None = None,
                   piece: int = PIECE) -> DataFrame:
    """Links (a, b) between the distinct sets of shingles that connect them as all pairs of likeness ``LIKE`` and more would, among
    the near pairs of the index. ``marked`` has the rows of ``_sketches``. Texts are read again for the sets of families only."""
    row = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("k"), F.col("_th").alias("t"))
    sets = stored(marked.groupBy("_set").agg(F.first("_fp").alias("_fp"), F.first("_node").alias("_node"), F.first("_size").alias("_size"),
                                             F.min(row).alias("_s")), "sets")
    links, nodes = None, sets.select("_fp", F.col("_node").alias("_root"), "_node").dropDuplicates(["_node"])
    for scheme in schemes:
        found = stored(near_links(nodes.select(F.concat("_fp", F.unhex(F.lpad(F.hex("_root"), 16, "0"))).alias("fp")), scheme, most), "links")
        links = found if links is None else links.union(found)
        roots = stored(components(links).toDF("_n", "_r"), "roots")
        nodes = sets.select("_fp", "_node").dropDuplicates(["_node"]).join(roots, F.col("_node") == F.col("_n"), "left").select(
            "_fp", F.coalesce("_r", "_node").alias("_root"), "_node")
    member = sets.join(roots, sets["_node"] == roots["_n"], "left").select("_set", "_fp", "_size", "_s", F.coalesce("_r", "_node").alias("_family"))
    families = member.groupBy("_family").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("s")).where("n > 1").select(
        "_family", F.expr(f"cast(greatest(ceil(n / {piece}), ceil(s * 8 / {PIECE_BYTES})) as int)").alias("_pieces"))
    wanted = stored(member.join(families, "_family").select("_set", "_fp", "_family", "_pieces", _named(F.col("_s.k")).alias("_rk"), F.col("_s.t").alias("_rt")), "wanted")
    rows = docs.select(_named(F.col(key)).alias("_rk"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_rt"), F.col(text).cast("binary").alias("_t"))
    texts = rows.join(wanted.select("_set", "_rk", "_rt"), ["_rk", "_rt"]).groupBy("_set").agg(F.first("_t").alias("_t"))
    hashes = _shingle_sets(texts, width)
    placed = wanted.select("_set", "_fp", "_family", F.pmod(F.xxhash64("_set"), F.col("_pieces")).cast("int").alias("_unit"), "_pieces").join(hashes, "_set")
    met = placed.select("_family", "_unit", "_set", "_fp", "_hashes", F.explode(F.expr("sequence(0, _pieces - 1)")).alias("_u")).select(
        "_family", F.least("_unit", "_u").alias("_lo"), F.greatest("_unit", "_u").alias("_hi"), "_unit", "_set", "_fp", "_hashes")
    dealt = met.repartition("_family", "_lo", "_hi").sortWithinPartitions("_family", "_lo", "_hi")
    return dealt.mapInArrow(_meetings([0, 1, 2], _alike(schemes)), "a long, b long")


def deduplicate(docs: DataFrame, key: str, text: str, width: int = 5, schemes: list[Scheme] = SIMILAR, most: int | None = None, piece: int = PIECE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of near copies (links: likeness of the
    sets of shingles ``LIKE`` and more) the row with the smallest key (nulls last; ties: the
    smallest hash of the text, then one of the rows with that key and text). All columns stay, of any names. A null text
    counts as empty, texts without words are copies of each other. An empty table gives an empty table."""
    marked = stored(_sketches(docs, key, text, width, schemes[0]), "marked")
    roots = components(verified_links(docs, marked, key, text, width, schemes, most, piece)).toDF("_n", "_r")
    best = marked.join(roots, marked["_set"] == roots["_n"], "left").groupBy(F.coalesce("_r", "_set").alias("root")).agg(
        F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("k"), F.col("_th").alias("t"))).alias("_s"))
    keep = best.select(_named(F.col("_s.k")).alias("_rk"), F.col("_s.t").alias("_rt"))
    rows = docs.select(F.struct("*").alias("_row"), _named(F.col(key)).alias("_rk"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_rt"))
    one = Window.partitionBy("_rk", "_rt").orderBy(F.lit(0))
    kept = rows.join(keep, ["_rk", "_rt"], "left_semi").withColumn("_n", F.row_number().over(one))
    return kept.where("_n = 1").select("_row.*")


def _named(key):
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("v"), key.cast("string")), F.lit("n"))


#: Words of a shingle in the registered query.
WIDTH = 4


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and its component of near copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = stored(fingerprints(docs, "text", WIDTH).select("doc_id", "simhash", "node"), "simhash")
    groups = near_components(marked, "doc_id", "simhash", "node").select(F.col("node").alias("_n"), "component_id")
    return marked.join(groups, marked["node"] == groups["_n"]).select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
