"""Removal of long byte strings that an earlier document has, by families of suffix arrays.

A document loses each byte that lies in a string of ``LENGTH`` bytes which also starts in a
document with a smaller key. Suffixes cannot all be shuffled whole, so they are anchored: of
the hashes of the ``GRAM``-byte strings inside a ``LENGTH``-byte window, the leftmost smallest
is the window's anchor. Equal windows have equal anchors, and an anchor stands for a run of
windows, its context: a suffix of ``WIDE`` bytes at most.

1. Documents lie in parts, as they are read. Parts send the hashes of their anchors; an anchor that is
   there once in all the corpus has no equal and is settled.
2. Of the rest, the contexts themselves are sent, equal ones of a part once. A task has a bucket of anchors
   and keeps a logarithmic family over its suffixes: batches, in the order of the keys, are sorted into a
   suffix array, scanned against the levels for matches with earlier documents, and added; levels of equal
   size merge. A context that an earlier document has goes whole. Where one anchor has several contexts,
   the ends of shared passages, a second family has their windows. Bytes are compared in both, never digests.

``Family`` keeps the levels of the first family as tables, so that batches of documents can come
one after the other: each is scanned against the levels of all before it.

Texts are stored once, without a shuffle. What a part sends to a bucket, and what comes back, is one row; a
bucket takes the hashes of ``FILTER`` or the contexts of ``BUCKET`` bytes of text.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_PARTITIONS, bucketed, input_bytes, list_folder, mix64, of_group, of_groups, pieces, put_text, scratch_path, stored

#: Bytes of a string, of the strings whose hashes make anchors, and of a context at most.
LENGTH, GRAM = 50, 20
WIDE = 2 * LENGTH - GRAM
#: Bytes of text of a part, of a bucket of hashes, of a bucket of contexts; suffixes of a batch.
PART, FILTER, BUCKET, BATCH = 1 << 23, 1 << 26, 1 << 24, 1 << 18
#: An odd factor for rolling hashes.
_FACTOR = 0x9E3779B97F4A7C15 | 1
_LAST = np.iinfo(np.int64).max
#: A context with its length behind it, so that equal ones are equal bytes; a window.
_CONTEXT, _WINDOW = np.dtype(f"V{WIDE + 1}"), np.dtype(f"V{LENGTH}")


def _rolled(data: np.ndarray, width: int) -> np.ndarray:
    """The hashes of all strings of ``width`` bytes, by doubling."""
    power, w, hashes = _FACTOR, 1, data.astype(np.uint64) + np.uint64(1)
    made, have = None, 0
    while True:
        if width & w:  # the strings so far, then this many bytes more
            n = max(0, len(data) - have - w + 1)
            made = hashes if made is None else made[:n] * np.uint64(power) + hashes[have:have + n]
            have += w
        if 2 * w > width:
            return made
        hashes = hashes[:-w] * np.uint64(power) + hashes[w:] if len(hashes) > w else hashes[:0]
        power, w = power * power % (1 << 64), 2 * w


def _anchors(joined: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts one behind the other, each anchor: where its first and its last window begin, and its hash."""
    starts = np.cumsum(sizes) - sizes
    found, i = [tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64))], 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 18))))
        a, z = int(starts[i]), int(starts[j - 1] + sizes[j - 1])
        # a text that is longer than a block is read by pieces; an anchor at a seam has two runs of windows
        step = 1 << 18 if j == i + 1 else z - a
        for at in range(a, max(z - LENGTH + 1, a + 1), max(step, 1)):
            piece = joined[at:min(z, at + step + LENGTH - 1)]
            first, last, hashes = _block_anchors(piece, sizes[i:j] if j > i + 1 else np.array([len(piece)]))
            found.append((first + at, last + at, hashes))
        i = j
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _block_anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    if len(data) < LENGTH:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64))
    low = mix64(_rolled(data, GRAM))
    at = np.arange(len(low), dtype=np.int32)
    span, width = 1, LENGTH - GRAM + 1
    while span < width:
        step = min(span, width - span)
        left = low[:-step] <= low[step:]
        low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
        span += step
    counts = np.maximum(sizes - LENGTH + 1, 0)  # windows that lie in one text
    ends = np.cumsum(counts)
    total = int(ends[-1])
    text = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(total) + np.repeat(np.cumsum(sizes) - sizes - (ends - counts), counts)
    anchor = at[place]
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0)) if total else np.zeros(0, np.int64)
    last = np.r_[new[1:], total] - 1 if total else new
    return place[new], place[last], low[place[new]]


class Levels:
    """A logarithmic family of sorted suffix arrays, each suffix with the smallest document that has it."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]] = ()):
        self.levels = list(levels)

    def earlier(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scan sorted suffixes against all levels: whether an earlier document has each."""
        least = np.full(len(keys), _LAST)
        for known, owner in self.levels:
            if len(known):
                where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[where] == keys
                least[hit] = np.minimum(least[hit], owner[where[hit]])
        return least < docs

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """A new smallest level of distinct sorted suffixes; levels of equal size merge."""
        self.levels.append((keys, docs))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            keys, docs, _ = merged(np.concatenate([a, b]), np.concatenate([x, y]))
            self.levels.append((keys, docs))


def merged(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct suffixes in their order, the smallest document of each, and where each suffix's first copy stood."""
    order = np.argsort(keys, kind="stable")  # sorted runs one behind the other are merged
    keys, docs = keys[order], docs[order]
    heads = _heads(keys)
    return keys[heads], np.minimum.reduceat(docs, heads) if len(heads) else docs, order[heads]


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def had_earlier(keys: np.ndarray, docs: np.ndarray, batch: int = BATCH, known: list[tuple[np.ndarray, np.ndarray]] = ()) -> np.ndarray:
    """For each suffix whether a document before its own has it too, in the same suffixes or in levels that are ``known``."""
    index, out = Levels(known), np.zeros(len(keys), bool)
    order = np.argsort(docs, kind="stable")
    for i in range(0, len(order), batch):
        pick = order[i:i + batch]
        pick = pick[np.argsort(keys[pick], kind="stable")]  # the batch's suffix array; equal ones stay in the order of documents
        k, d = keys[pick], docs[pick]
        heads = _heads(k)
        inside = np.repeat(d[heads], np.diff(np.r_[heads, len(k)])) < d
        out[pick] = inside | index.earlier(k, d)
        if i + batch < len(order):
            index.add(k[heads], d[heads])
    return out


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<i8")).view(np.uint8).reshape(-1, 8).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _bits(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _flags(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=count).astype(bool)


def _pack_contexts(contexts: np.ndarray) -> bytes:
    table = contexts.view(np.uint8).reshape(-1, WIDE + 1)
    inside = np.arange(WIDE) < table[:, WIDE:]
    return zlib.compress(np.ascontiguousarray(table[:, WIDE]).tobytes() + table[:, :WIDE][inside].tobytes(), 1)


def _unpack_contexts(data: bytes, count: int) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), np.uint8)
    table = np.zeros((count, WIDE + 1), np.uint8)
    table[:, WIDE] = flat[:count]
    table[:, :WIDE][np.arange(WIDE) < table[:, WIDE:]] = flat[count:]
    return table.view(_CONTEXT).ravel()


def _groups(numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers."""
    heads = _heads(numbers)
    for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(numbers)]):
        yield int(numbers[a]), slice(a, z)


class Part:
    """A part's documents and their anchors. ``codes`` are the distinct buckets and hashes of the anchors, in order."""

    def __init__(self, table: pa.Table, key: str, text: str, filters: int):
        self.table = table
        self.keys = np.array([-_LAST - 1 if k is None else k for k in table.column(key).to_pylist()], np.int64)
        texts = table.column(text).to_pylist()
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join([*texts, bytes(WIDE)]), np.uint8)  # so that every context has its full width
        del texts
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first, self.last, self.hash = _anchors(self.data[:len(self.data) - WIDE], self.sizes)
        self.doc = self.keys[np.searchsorted(self.starts + self.sizes, self.first, "right")]
        code = self.hash % np.uint64(filters) << np.uint64(32) | self.hash // np.uint64(filters) & np.uint64(0xFFFFFFFF)
        self.codes, self.code, self.times = np.unique(code, return_inverse=True, return_counts=True)

    def contexts(self, there: np.ndarray, buckets: int) -> None:
        """The suffix array of the anchors whose codes are ``there``: ``rows`` are the distinct contexts, by bucket and then
        by their bytes, ``least`` the smallest document of each, ``number`` the row of each of the anchors ``at``."""
        self.at = np.flatnonzero(there[self.code])
        length = self.last[self.at] - self.first[self.at] + LENGTH
        table = np.empty((len(self.at), WIDE + 1), np.uint8)
        table[:, :WIDE] = np.lib.stride_tricks.sliding_window_view(self.data, WIDE)[self.first[self.at]]
        table[:, :WIDE][np.arange(WIDE) >= length[:, None]] = 0
        table[:, WIDE] = length
        rows = table.view(_CONTEXT).ravel()
        order = np.argsort(rows, kind="stable")
        heads = _heads(rows[order])
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(order)]))
        hashes = self.hash[self.at][order[heads]]
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        dealt = np.argsort(bucket, kind="stable")
        place = np.empty(len(dealt), np.int64)
        place[dealt] = np.arange(len(dealt))
        self.number, self.bucket = place[number], bucket[dealt]
        self.rows = rows[order[heads[dealt]]]
        self.group = (hashes[dealt] // np.uint64(buckets) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.least = np.minimum.reduceat(self.doc[self.at][order], heads)[dealt] if len(heads) else np.zeros(0, np.int64)

    def there(self, replies: dict[int, bytes] | None) -> np.ndarray:
        """Per code whether the corpus has it more than once; without replies, all are taken."""
        out = np.ones(len(self.codes), bool)
        if replies is not None:
            for b, own in _groups(self.codes >> np.uint64(32)):
                out[own] = _flags(replies[b], own.stop - own.start)
        return out


_HASHES = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_bucket", T.IntegerType()), T.StructField("_hash", T.BinaryType()),
                        T.StructField("_again", T.BinaryType())])
_CONTEXTS = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_bucket", T.IntegerType()), T.StructField("_group", T.BinaryType()),
                          T.StructField("_rows", T.BinaryType()), T.StructField("_doc", T.BinaryType())])
#: Replies to parts (``_late``: about contexts), and levels, which have numbers below zero for a part.
_REPLY = T.StructType([T.StructField("_late", T.BooleanType()), *_CONTEXTS.fields, T.StructField("_flags", T.BinaryType()), T.StructField("_bits", T.BinaryType())])


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.table([pa.array(list(c), k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)


def _reply(late: bool, part: int, bucket: int, flags: bytes, bits: bytes | None) -> tuple:
    return (late, part, bucket, None, None, None, flags, bits)


def _send_hashes(key: str, text: str, filters: int):
    def run(table: pa.Table) -> pa.Table:
        part, p = table.column("_part")[0].as_py(), Part(table, key, text, filters)
        low, rows = p.codes & np.uint64(0xFFFFFFFF), []
        for b, own in _groups(p.codes >> np.uint64(32)):
            rows.append((part, b, _pack(np.diff(low[own].astype(np.int64), prepend=0)), _bits(p.times[own] > 1)))
        return _table(rows, _HASHES)

    return run


def _filter(table: pa.Table) -> pa.Table:
    """Of a bucket's hashes, which are there more than once."""
    rows = table.to_pylist()
    hashes = [np.cumsum(_unpack(r["_hash"])).astype(np.uint32) for r in rows]
    every = np.sort(np.concatenate(hashes))
    several = np.append(np.unique(every[1:][every[1:] == every[:-1]]), np.uint32(0xFFFFFFFF))
    del every
    out = []
    for r, own in zip(rows, hashes, strict=True):
        where = np.searchsorted(several[:-1], own)
        again = ((several[where] == own) & (where < len(several) - 1)) | _flags(r["_again"], len(own))
        out.append(_reply(False, r["_part"], r["_bucket"], _bits(again), None))
    return _table(out, _REPLY)


def _send_contexts(key: str, text: str, filters: int, buckets: int, filtered: bool):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _CONTEXTS)
        part, p = table.column("_part")[0].as_py(), Part(table, key, text, filters)
        p.contexts(p.there(_by_bucket(replies, "_flags") if filtered else None), buckets)
        return _table([(part, b, p.group[own].astype("<u4").tobytes(), _pack_contexts(p.rows[own]), _pack(np.diff(p.least[own], prepend=0)))
                       for b, own in _groups(p.bucket)], _CONTEXTS)

    return run


def _by_bucket(replies: pa.Table, column: str) -> dict[int, bytes]:
    return dict(zip(replies.column("_bucket").to_pylist(), replies.column(column).to_pylist()))


def _windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of contexts, and the number of each one's context."""
    if not len(rows):
        return np.zeros(0, _WINDOW), np.zeros(0, np.int64)
    table = rows.view(np.uint8).reshape(-1, WIDE + 1)
    counts = table[:, WIDE].astype(np.int64) - LENGTH + 1
    number = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(table).ravel(), LENGTH)[number * (WIDE + 1) + inside]
    return np.ascontiguousarray(windows).view(_WINDOW).ravel(), number


def _scan(batch: int, level: int | None, merge: tuple[int, ...]):
    """A bucket's contexts of the new parts against each other and the levels that are there; with ``level``, also the new
    level of that number: the new contexts and those of the levels ``merge``."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["_part"])
        group = [np.frombuffer(r["_group"], "<u4") for r in rows]
        keys = [_unpack_contexts(r["_rows"], len(g)) for r, g in zip(rows, group, strict=True)]
        docs = [np.cumsum(_unpack(r["_doc"])) for r in rows]
        old = [i for i, r in enumerate(rows) if r["_part"] < 0]
        new = range(len(old), len(rows))
        join = lambda parts, of, kind: np.concatenate([np.zeros(0, kind), *(of[i] for i in parts)])
        own, own_docs, own_group = join(new, keys, _CONTEXT), join(new, docs, np.int64), join(new, group, np.uint32)
        goes = had_earlier(own, own_docs, batch, [(keys[i], docs[i]) for i in old])
        # of one anchor's several contexts, the windows are looked up
        stays = np.sort(own_group[~goes])
        several = stays[1:][stays[1:] == stays[:-1]]
        known_group = join(old, group, np.uint32)
        several = np.unique(np.concatenate([several, np.intersect1d(stays, known_group)]))
        ask = np.flatnonzero(~goes & np.isin(own_group, several))
        also = np.flatnonzero(np.isin(known_group, several))
        windows, number = _windows(own[ask])
        more, whose = _windows(join(old, keys, _CONTEXT)[also])
        found = had_earlier(np.concatenate([windows, more]), np.concatenate([own_docs[ask][number], join(old, docs, np.int64)[also][whose]]), batch)[:len(windows)]
        flags = goes.astype(np.uint8)
        flags[ask] = 2
        out, a = [], 0
        bounds = np.searchsorted(number, np.searchsorted(ask, np.cumsum([0, *(len(keys[i]) for i in new)])))
        for n, i in enumerate(new):
            z = a + len(keys[i])
            out.append(_reply(True, rows[i]["_part"], rows[i]["_bucket"], zlib.compress(flags[a:z].tobytes(), 1), _bits(found[bounds[n]:bounds[n + 1]])))
            a = z
        if level is not None:
            parts = [*(i for i in old if rows[i]["_part"] in merge), *new]
            k, d, first = merged(join(parts, keys, _CONTEXT), join(parts, docs, np.int64))
            out.append((True, level, rows[0]["_bucket"], join(parts, group, np.uint32)[first].astype("<u4").tobytes(), _pack_contexts(k),
                        _pack(np.diff(d, prepend=0)), None, None))
        return _table(out, _REPLY)

    return run


def _cut(key: str, text: str, filters: int, buckets: int, filtered: bool, names: list[str], result: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = to_arrow_schema(result)
        if not table.num_rows:
            return pa.table([pa.array([], k.type) for k in kinds], schema=kinds)
        p = Part(table, key, text, filters)
        late = replies.column("_late").to_numpy(zero_copy_only=False).astype(bool) if replies.num_rows else np.zeros(0, bool)
        p.contexts(p.there(_by_bucket(replies.filter(pa.array(~late)), "_flags") if filtered else None), buckets)
        replies = replies.filter(pa.array(late))
        told, found = _by_bucket(replies, "_flags"), _by_bucket(replies, "_bits")
        flags, bits = np.zeros(len(p.rows), np.uint8), []
        counts = p.rows.view(np.uint8).reshape(-1, WIDE + 1)[:, WIDE].astype(np.int64) - LENGTH + 1
        for b, own in _groups(p.bucket):
            flags[own] = np.frombuffer(zlib.decompress(told[b]), np.uint8)
            bits.append(_flags(found[b], int(counts[own][flags[own] == 2].sum())))
        bits = np.concatenate([np.zeros(0, bool), *bits])
        asked = np.where(flags == 2, counts, 0)
        offset = np.cumsum(asked) - asked
        # per anchor: gone whole, or by windows
        first, last = p.first[p.at], p.last[p.at]
        whole = (p.doc[p.at] > p.least[p.number]) | (flags[p.number] == 1)
        some = np.flatnonzero(~whole & (flags[p.number] == 2))
        n = counts[p.number[some]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = bits[np.repeat(offset[p.number[some]], n) + inside]
        one = (np.repeat(first[some], n) + inside)[gone]
        change = np.zeros(len(p.data) - WIDE + 1, np.int32)
        np.add.at(change, np.concatenate([first[whole], one]), 1)
        np.add.at(change, np.concatenate([last[whole], one]) + LENGTH, -1)
        gone = np.cumsum(change, out=change)[:-1] > 0
        del change
        begins = gone & ~np.r_[False, gone[:-1]]
        begins[p.starts[(p.sizes > 0)]] = gone[p.starts[(p.sizes > 0)]]  # a run never reaches from a text into the next
        ends = p.starts + p.sizes
        before = [np.r_[np.int32(0), np.cumsum(x, dtype=np.int32)] for x in (gone, begins)]
        removed, spans = ((b[ends] - b[p.starts]).astype(np.int64) for b in before)
        kept = [t if not n else p.data[a:z][~gone[a:z]].tobytes()
                for t, n, a, z in zip(p.table.column(text).to_pylist(), removed.tolist(), p.starts.tolist(), ends.tolist())]
        columns = [*(p.table.column(n) for n in names), pa.array(kept, pa.binary()), pa.array(p.sizes), pa.array(removed), pa.array(spans)]
        return pa.table([c.cast(k.type) if c.type != k.type else c for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    return run


def _parts(text: int, part: int, names: list[str]):
    """Rows with the number of their part: about ``part`` bytes of text as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            before = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
            before = np.r_[0, before[:-1]] + size if len(before) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number + before // part)], names=names)
            size = int(before[-1]) + len(batch.column(text)[-1].as_buffer() or b"") if len(before) else size

    return run


def _laid(docs: DataFrame, key: str, text: str, part: int, parts: int) -> tuple[DataFrame, list[str]]:
    """The documents as they are judged (``_text``: bytes), in parts, stored."""
    others = [c for c in docs.columns if c not in (key, text)]
    rows = docs.select(F.col(key).cast("long").alias(key), *others, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.LongType())])
    # a part comes from one task, so the texts can be laid out by part where they are
    return bucketed(rows.mapInArrow(_parts(len(rows.columns) - 1, part, schema.names), schema), "_part", 2 * parts, "texts", deal=False), [key, *others]


def _remove(docs: DataFrame, key: str, text: str, part: int, buckets: int | None, batch: int, levels: DataFrame | None = None,
            level: int | None = None, merge: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The documents without their repeats, and the replies with the new level. With ``level``, anchors that are there once are kept too."""
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", *(n for n in (*_REPLY.names, "_text") if n not in (key, text)))
    total, filtered = input_bytes(docs, text), level is None
    # parts and buckets are dealt by the text's size; ``part`` scales them, as in tests
    filters = min(pieces(total, part * (FILTER // PART)), MOST_PARTITIONS)
    buckets = buckets or min(pieces(total, part * (BUCKET // PART)), MOST_PARTITIONS)
    laid, names = _laid(docs, key, text, part, pieces(total, part))
    anchored = laid.select(key, "_text", "_part")
    none = docs.sparkSession.createDataFrame([], _REPLY)
    early = none
    if filtered:
        sent = anchored.groupBy("_part").applyInArrow(of_group(_send_hashes(key, "_text", filters)), _HASHES)
        early = stored(sent.groupBy("_bucket").applyInArrow(of_group(_filter), _REPLY), "settled")
    asked = anchored.groupBy("_part").cogroup(early.groupBy("_part")).applyInArrow(
        of_groups(_send_contexts(key, "_text", filters, buckets, filtered)), _CONTEXTS)
    asked = asked if levels is None else asked.unionByName(levels)
    late = stored(asked.groupBy("_bucket").applyInArrow(of_group(_scan(batch, level, merge)), _REPLY), "replies")
    replies = early.unionByName(late.where("_part >= 0")).select("_part", "_late", "_bucket", "_flags", "_bits")
    result = T.StructType([*(laid.schema[n] for n in names), T.StructField("kept", T.BinaryType()),
                           *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans"))])
    cut = _cut(key, "_text", filters, buckets, filtered, names, result)
    return laid.groupBy("_part").cogroup(replies.groupBy("_part")).applyInArrow(of_groups(cut), result), late


def remove_repeats(docs: DataFrame, key: str, text: str, part: int = PART, batch: int = BATCH) -> DataFrame:
    """``docs`` with ``kept`` (the bytes of the text that stay), ``n_bytes``, ``n_removed`` and
    ``n_spans`` (maximal removed runs). Strings are judged on the texts as they come in.

    ``key`` is a whole number; rows of one key don't remove each other's bytes, and a null
    key comes before all others. A null text counts as empty. Texts shorter than ``LENGTH``
    bytes stay whole. Every row and other column stays; columns with one of the four names, or
    of the operator's own (they begin with ``_``: ``_text``, ``_part``, ``_bucket``, ``_late``, ``_group``,
    ``_rows``, ``_doc``, ``_flags``, ``_bits``), are replaced or left out. An empty table gives an empty table.
    """
    return _remove(docs, key, text, part, None, batch)[0]


class Family:
    """Batches of documents, one after the other, against the suffix arrays of all batches before.

    The levels are tables under ``path``, sorted suffix arrays by bucket of anchors. A new batch gets its own,
    is scanned against them, and merges with the levels that are not over twice its size. ``levels-<n>`` names the
    tables that count after the n-th batch; a batch that fails leaves no such name and can come again. Batches
    come in the order of their keys: a document is only ever judged by smaller keys, and by batches that are there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, part: int = PART, batch: int = BATCH):
        self.spark, self.path, self.buckets, self.part, self.batch = spark, path, buckets, part, batch

    def levels(self) -> tuple[int, list[dict]]:
        """How many batches there were, and their levels: table, number and bytes of text."""
        names = sorted(int(n.removeprefix("levels-")) for n in list_folder(self.spark, self.path) if n.startswith("levels-"))
        if not names:
            return 0, []
        text = self.spark.read.text(f"{self.path}/levels-{names[-1]}").first()[0]
        return names[-1], json.loads(text)

    def remove(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """As ``remove_repeats``, for the next batch."""
        n, levels = self.levels()
        size, merge, stay = input_bytes(docs, text), [], list(levels)
        while stay and stay[-1]["bytes"] <= 2 * size:
            merge.append(stay.pop())
            size += merge[-1]["bytes"]
        known = [self.spark.read.schema(_CONTEXTS).parquet(f"{self.path}/{v['table']}") for v in levels]
        known = [k.withColumn("_part", F.lit(v["number"]).cast("long")) for k, v in zip(known, levels, strict=True)]
        both = None
        for k in known:
            both = k if both is None else both.unionByName(k)
        number = -n - 1
        out, late = _remove(docs, key, text, self.part, self.buckets, self.batch, both, number, tuple(v["number"] for v in merge))
        table = scratch_path(self.spark, "level", keep=True).rsplit("/", 1)[1]
        late.where("_part < 0").select(_CONTEXTS.names).write.option("compression", "zstd").parquet(f"{self.path}/{table}")
        put_text(self.spark, f"{self.path}/levels-{n + 1}", json.dumps([*stay, {"table": table, "number": number, "bytes": size}]))
        return out


def whole_characters(kept: Column) -> Column:
    """The kept bytes as text. A character of which a part was removed goes: what UTF-8 cannot
    read is left out."""
    return F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("�"), F.lit(""))


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to documents before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, "doc_id", "text").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
