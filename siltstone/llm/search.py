"""Exact top-k search by BM25: an inverted index per shard, block-max WAND, an exact merge.

One pass reads the texts where they lie. Every ``SHARD`` bytes of text become a shard: its
postings (term, document, count) are written to the shared folder, and so are its terms'
document counts and the queries' terms, from which the statistics of the whole corpus are
added up. Texts are never shuffled, and the index is built once, whatever the number of queries.

Queries are a stated set. They come past the stored index in blocks of ``QUERY_BYTES``, each
broadcast. A task goes through its shards and keeps the ``k`` best hits of each query. Inside a
shard, documents lie in blocks with the largest impact of each term. A query's cursor moves
through the blocks in order; its pivot is the next block whose maxima sum to the query's threshold, the k-th score so far; blocks before it are
not read. The threshold rises with every hit, from shard to shard too, and the blocks of the largest
sums are read first, so that it starts high. Every shard uses the statistics of the whole corpus, so the
tasks' lists are on one scale and their merge is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_PARTITIONS, input_bytes, of_group, pieces, scratch_path, stored, tidy

#: BM25's constants, documents of a block, bytes of text of a shard, bytes of a block of queries' terms.
K1, B, BLOCK, SHARD, QUERY_BYTES = 1.2, 0.75, 64, 5 << 23, 1 << 25
#: A term in more than this part of a shard's documents is kept as a full row of impacts; the most frequent ones at most, and cells of all rows.
DENSE, MOST_ROWS, ROW_CELLS = 0.01, 4096, 3 << 23
#: Blocks that are read first, queries that are worked on together, the entries of their cursors at most (or of one query), scores summed exactly at a time, and pairs that may wait for that.
FIRST, TOGETHER, CURSORS, EXACT, KEPT = 4, 512, 1 << 20, 4096, 1 << 18
#: Decimals that scores are rounded to, so that ties don't depend on the order of a sum, and what sums may be off by.
DECIMALS, SLACK = 9, 1e-6
_SPACED = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 else 0x20 for c in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def terms(text: str | None, hashes: dict) -> np.ndarray:
    """Hashes of a text's words (runs of letters and digits, lowered), in order."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()
    return np.fromiter((hashes[w] for w in words), np.uint64, len(words))


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, byte planes apart, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<i8")).view(np.uint8).reshape(-1, 8).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


class Postings:
    """What a shard stores: its documents' keys (``none``: the key is null) and lengths, its sorted terms, and the
    postings in the order of terms and documents."""

    def __init__(self, ids: list, found: list[np.ndarray]):
        parts = [np.unique(t, return_counts=True) for t in found]
        length = np.array([len(t) for t in found], np.int64)
        # like documents side by side: those of one most frequent word, by length; a block's maxima are then close to its documents'
        alike = np.array([p[0][p[1].argmax()] if len(p[0]) else 0 for p in parts], np.uint64)
        placed = np.lexsort((length, alike))
        self.none = np.array([ids[i] is None for i in placed], bool)
        self.ids = np.array([ids[i] or 0 for i in placed], np.int64)
        self.length = length[placed]
        place = np.empty(len(ids), np.int64)
        place[placed] = np.arange(len(ids))
        doc = np.repeat(place, [len(p[0]) for p in parts])
        term = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
        tf = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
        del parts
        order = np.lexsort((doc, term))
        term, self.doc, self.tf = term[order], doc[order], tf[order]
        heads = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        self.terms, self.starts = term[heads], np.r_[heads, len(term)].astype(np.int64)

    def pack(self) -> tuple[bytes, ...]:
        places = np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * len(self.ids) + self.doc
        return (self.ids.tobytes(), np.packbits(self.none).tobytes(), _pack(self.length), self.terms.tobytes(),
                _pack(np.diff(places, prepend=0)), _pack(self.tf))

    @classmethod
    def unpack(cls, ids: bytes, none: bytes, length: bytes, terms_: bytes, places: bytes, tf: bytes) -> Postings:
        self = cls.__new__(cls)
        self.ids, self.length, self.terms, self.tf = np.frombuffer(ids, np.int64), _unpack(length), np.frombuffer(terms_, np.uint64), _unpack(tf)
        self.none = np.unpackbits(np.frombuffer(none, np.uint8), count=len(self.ids)).astype(bool)
        number, self.doc = np.divmod(np.cumsum(_unpack(places)), max(1, len(self.ids)))
        self.starts = np.searchsorted(number, np.arange(len(self.terms) + 1))
        return self


class Queries:
    """A block of queries: their keys, and their terms as numbers in a list of all their terms with the weights of these."""

    def __init__(self, ids: list[int], found: list[np.ndarray], df: list[np.ndarray], n: int):
        # like queries side by side, as a shard's documents are: they need the same blocks
        order = sorted(range(len(ids)), key=lambda i: int(found[i][df[i].argmax()]) if len(found[i]) else 0)
        ids, found, df = ([x[i] for i in order] for x in (ids, found, df))
        self.ids, self.starts = np.array(ids, np.int64), np.cumsum([0, *map(len, found)])
        self.vocabulary, first, where = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_index=True, return_inverse=True)
        self.terms = where.astype(np.int32)
        count = np.concatenate([np.zeros(0, np.int64), *df])[first]
        self.weight = np.log1p((n - count + 0.5) / (count + 0.5))


class Best:
    """The ``k`` best hits of each query so far: score, then the smaller key, keys that are null last. Free places have the score 0."""

    def __init__(self, queries: int, k: int):
        self.k, self.score = k, np.zeros((queries, k))
        self.ids, self.none = np.zeros((queries, k), np.int64), np.zeros((queries, k), bool)
        self.least = np.zeros(queries)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Scores of the queries ``at`` for the documents ``ids``, which may differ from query to query."""
        score = np.round(score, DECIMALS)
        better = (score.max(1) >= self.least[at]) & (score.max(1) > 0)
        at, score = at[better], score[better]
        if not len(at):
            return
        ids, none = np.broadcast_to(ids, better.shape + ids.shape[-1:])[better], np.broadcast_to(none, better.shape + none.shape[-1:])[better]
        score = np.concatenate([self.score[at], score], 1)
        ids, none = np.concatenate([self.ids[at], ids], 1), np.concatenate([self.none[at], none], 1)
        best = np.lexsort((ids, none, -score), axis=1)[:, :self.k]
        self.score[at], self.ids[at], self.none[at] = (np.take_along_axis(x, best, 1) for x in (score, ids, none))
        self.least[at] = self.score[at, -1]


class Index:
    """A shard's index under the statistics of the corpus: impacts, and the largest of each term and block."""

    def __init__(self, stored_: Postings, mean: float):
        self.ids, self.none, self.terms, starts, doc = stored_.ids, stored_.none, stored_.terms, stored_.starts, stored_.doc
        self.n = len(self.ids)
        impact = stored_.tf.astype(float)
        impact = impact * (K1 + 1) / (impact + K1 * (1 - B + B * stored_.length[doc] / mean)) if mean else impact
        self.blocks = -(-self.n // BLOCK)
        # postings of a term and block lie together: a run
        count = np.diff(starts)
        key = np.repeat(np.arange(len(self.terms)), count) * max(1, self.blocks) + doc // BLOCK
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        del key
        self.most = np.maximum.reduceat(impact, heads) if len(heads) else np.zeros(0)
        self.run_block = (doc[heads] // BLOCK).astype(np.int32)
        self.run_length = np.diff(heads, append=len(doc)).astype(np.int32)
        self.first_run = np.searchsorted(heads, starts)
        # the most frequent terms get full rows, as far as these have room
        runs = np.diff(self.first_run)
        common = np.flatnonzero(count > DENSE * self.n)
        common = common[np.argsort(-count[common], kind="stable")][:MOST_ROWS]
        common = np.sort(common[np.cumsum(runs[common]) * BLOCK <= ROW_CELLS])
        self.row_of = np.full(len(self.terms) + 1, -1, np.int32)
        self.row_of[common] = np.arange(len(common))
        row = np.repeat(self.row_of[:-1], runs)
        self.row_most = np.zeros((len(common), self.blocks), np.float32)
        self.row_most[row[row >= 0], self.run_block[row >= 0]] = self.most[row >= 0]
        row = np.repeat(self.row_of[:-1], count)
        held = np.flatnonzero(row >= 0)
        held = held[np.argsort(doc[held], kind="stable")]
        # full rows, by documents for an exact sum, and by blocks with the columns of the terms that occur there
        self.own_row, self.own_impact = row[held], impact[held]
        self.own_starts = np.searchsorted(doc[held], np.arange(self.n + 1))
        line = doc[held] % BLOCK
        del row, held
        self.columns, self.rows = [], []
        for b in range(self.blocks):
            columns = np.flatnonzero(self.row_most[:, b])
            mine = slice(self.own_starts[b * BLOCK], self.own_starts[min(self.n, (b + 1) * BLOCK)])
            rows = np.zeros((min(BLOCK, self.n - b * BLOCK), len(columns)), np.float32)
            rows[line[mine], np.searchsorted(columns, self.own_row[mine])] = self.own_impact[mine]
            self.columns.append(columns)
            self.rows.append(rows)
        # all postings, by blocks
        order = _by(self.run_block, self.blocks)
        length = self.run_length[order].astype(np.int64)
        self.run_at = np.empty(len(heads), np.int64)
        self.run_at[order] = np.cumsum(length) - length
        moved = _runs(heads[order], length)
        self.line, self.impact = (doc[moved] % BLOCK).astype(np.int32), impact[moved]

    def search(self, queries: Queries, best: Best) -> int:
        """Bring ``best`` up to date with this shard; returns how many pairs of a query and a block were read."""
        if not self.n or not len(self.terms):
            return 0
        where = np.minimum(np.searchsorted(self.terms, queries.vocabulary), len(self.terms) - 1)
        where[self.terms[where] != queries.vocabulary] = -1
        local = where[queries.terms]
        row, runs = self.row_of[local], np.diff(self.first_run)[local]
        runs[(local < 0) | (row >= 0)] = 0
        cursors = np.r_[0, np.cumsum(runs)][queries.starts]
        read, a = 0, 0
        while a < len(queries.ids):
            z = min(a + TOGETHER, len(queries.ids), max(a + 1, int(np.searchsorted(cursors, cursors[a] + CURSORS, "right")) - 1))
            read += self._sweep(queries, best, a, z, local, row, runs)
            a = z
        return read

    def _sweep(self, queries: Queries, best: Best, a: int, z: int, local: np.ndarray, row: np.ndarray, runs: np.ndarray) -> int:
        mine = slice(queries.starts[a], queries.starts[z])
        number = np.repeat(np.arange(z - a), np.diff(queries.starts[a:z + 1]))
        weight, local, row, runs = queries.weight[queries.terms[mine]], local[mine], row[mine], runs[mine]
        full = np.zeros((z - a, len(self.row_most)))  # the queries' weights of the terms with full rows
        common = (local >= 0) & (row >= 0)
        full[number[common], row[common]] = weight[common]
        short = np.ascontiguousarray(full.T, np.float32)
        # no summand is below 0, so a sum in single precision is off by this part of itself at most
        off = (np.bincount(number[common], minlength=z - a) + 8) * 2.0 ** -23
        # the cursors of the other terms: their runs, in the order of blocks
        run = _runs(self.first_run[local], runs).astype(np.int32)
        who, heavy, block = np.repeat(number.astype(np.int32), runs), np.repeat(weight, runs), self.run_block[run]
        pair = who * np.int64(self.blocks) + block
        bound = np.bincount(pair, self.most[run] * heavy, (z - a) * self.blocks).astype(float).reshape(z - a, self.blocks)
        bound += (short.T @ self.row_most) * (1 + 2 * off[:, None])
        # the k-th score is known to be this at least: by exact scores and, of this sweep, by sums in single precision less what they are off
        least, tops = best.least[a:z].copy(), best.score[a:z].copy()
        waiting = (bound > 0) & (bound >= least[:, None] - SLACK)
        left = np.flatnonzero(waiting.ravel()[pair])
        left = left[_by(block[left], self.blocks)]
        run, who, heavy = run[left], who[left], heavy[left]
        cuts = np.searchsorted(block[left], np.arange(self.blocks + 1))
        del pair, block, left
        # a query without k hits yet reads the blocks of the largest sums first
        first = np.zeros(bound.shape, bool)
        new = np.flatnonzero(least == 0)
        if len(new):
            first[new[:, None], np.argpartition(-bound[new], min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST]] = True

        def settle() -> None:
            if kept:
                who, doc, near, rest = map(np.concatenate, zip(*kept, strict=True))
                kept.clear()
                last = np.flatnonzero(near >= least[who] * (1 - off[who]) - SLACK)
                last = last[np.argsort(who[last], kind="stable")]
                for i in range(0, len(last), EXACT):
                    part = last[i:i + EXACT]
                    self._exact(best, a, who[part], doc[part], full, rest[part])

        kept, read, room = [], 0, np.empty((max(map(len, self.columns)), z - a), np.float32)
        for early in (True, False) if len(new) else (False,):
            for b in range(self.blocks):
                here = waiting[:, b] & (bound[:, b] >= least - SLACK)
                if early:
                    here &= first[:, b]
                    waiting[:, b] &= ~here
                at = np.flatnonzero(here)
                if not len(at):
                    continue
                read += len(at)
                docs = slice(b * BLOCK, min(self.n, (b + 1) * BLOCK))
                width = docs.stop - docs.start
                mine, place = slice(cuts[b], cuts[b + 1]), np.cumsum(here) - 1
                at_run, asker, by = run[mine], who[mine], heavy[mine]
                if len(at) < z - a:
                    seen = here[asker]
                    at_run, asker, by = at_run[seen], asker[seen], by[seen]
                counts = self.run_length[at_run]
                posting = _runs(self.run_at[at_run], counts)
                cell = np.repeat(place[asker] * width, counts) + self.line[posting]
                rest = np.bincount(cell, self.impact[posting] * np.repeat(by, counts), len(at) * width).astype(float).reshape(len(at), width)
                some = np.take(short, self.columns[b], axis=0, out=room[:len(self.columns[b])], mode="clip")
                if 4 * len(at) > at[-1] + 1 - at[0]:  # like queries are side by side
                    near = (self.rows[b] @ some[:, at[0]:at[-1] + 1])[:, at - at[0]].T
                else:
                    near = (self.rows[b] @ some[:, at]).T
                near += rest
                maybe = (near >= (least[at] * (1 - off[at]) - SLACK)[:, None]) & (near > 0)
                rows = np.flatnonzero(maybe.any(1))
                if len(rows):
                    asked = at[rows]
                    seen = np.concatenate([tops[asked], np.where(maybe[rows], near[rows] * (1 - 2 * off[asked, None]), 0)], 1)
                    tops[asked] = np.partition(seen, -best.k, axis=1)[:, -best.k:]
                    least[asked] = np.maximum(least[asked], tops[asked].min(1))
                    maybe[rows] &= near[rows] >= (least[asked] * (1 - off[asked]) - SLACK)[:, None]
                    which, found = np.nonzero(maybe)
                    kept.append((at[which], docs.start + found, near[which, found], rest[which, found]))
                    if sum(len(x[0]) for x in kept) > KEPT:  # many ties
                        settle()
        settle()
        return read

    def _exact(self, best: Best, a: int, who: np.ndarray, doc: np.ndarray, full: np.ndarray, rest: np.ndarray) -> None:
        """The scores of some queries (places behind ``a``, in their order) for a document each, in double precision."""
        start = self.own_starts[doc]
        counts = self.own_starts[doc + 1] - start
        held, pair = _runs(start, counts), np.repeat(np.arange(len(doc)), counts)
        score = np.bincount(pair, self.own_impact[held] * full[who[pair], self.own_row[held]], len(doc)) + rest
        asked, first, counts = np.unique(who, return_index=True, return_counts=True)
        cell = np.repeat(np.arange(len(asked)), counts), np.arange(len(who)) - np.repeat(first, counts)
        wide = len(asked), counts.max()
        table, ids, none = np.zeros(wide), np.zeros(wide, np.int64), np.zeros(wide, bool)
        table[cell], ids[cell], none[cell] = score, self.ids[doc], self.none[doc]
        best.add(a + asked, table, ids, none)


def _by(block: np.ndarray, blocks: int) -> np.ndarray:
    """The order by blocks, stable; short numbers are sorted by radix."""
    return np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


_SHARD = [T.StructField(n, T.BinaryType()) for n in ("_ids", "_none", "_lengths", "_all", "_places", "_tf")]
#: A shard (its words in ``_words``), or a bucket's document counts in a shard, or the terms of a query in a bucket.
_PASS = T.StructType([T.StructField("_bucket", T.IntegerType()), T.StructField("_query", T.LongType()), T.StructField("_terms", T.BinaryType()),
                      T.StructField("_df", T.BinaryType()), T.StructField("_words", T.LongType()), *_SHARD])
_QUERY = T.StructType([T.StructField("_query", T.LongType()), T.StructField("_terms", T.BinaryType()), T.StructField("_df", T.BinaryType())])
_HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _table(rows: list[tuple], schema: T.StructType) -> list[pa.Array]:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return [pa.array(list(c), kinds[f.dataType]) for c, f in zip(columns, schema, strict=True)]


def _read(buckets: int, shard_bytes: int):
    """The pass over the texts: shards, document counts and queries' terms."""

    def dealt(found: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = (found % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for pick in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            yield int(bucket[pick[0]]), pick

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, held, size = _Hashes(), [], [], 0
        nothing = (None,) * len(_SHARD)

        def flush() -> pa.RecordBatch:
            shard = Postings(ids, held)
            rows = [(-1, None, None, None, int(shard.length.sum()), *shard.pack())]
            df = np.diff(shard.starts)
            rows += [(b, None, shard.terms[pick].tobytes(), _pack(df[pick]), None, *nothing) for b, pick in dealt(shard.terms)]
            ids.clear()
            held.clear()
            tidy()
            return pa.RecordBatch.from_arrays(_table(rows, _PASS), names=_PASS.names)

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, asks = batch.slice(i, 500), []
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).to_pylist()
                for key, text, query, length in zip(*(part.column(c).to_pylist() for c in range(3)), sizes, strict=True):
                    found = terms(text, hashes)
                    ids.append(key)
                    held.append(found)
                    size += length
                    if query is not None:
                        own = np.unique(found)
                        asks += [(b, query, own[pick].tobytes(), None, None, *nothing) for b, pick in dealt(own)]
                    if size >= shard_bytes:
                        size = 0
                        yield flush()
                if asks:
                    yield pa.RecordBatch.from_arrays(_table(asks, _PASS), names=_PASS.names)
        if ids:
            yield flush()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The corpus's document counts of the queries' terms of one bucket."""
    asks, told = [], []
    for row in table.to_pylist():
        (told if row["_query"] is None else asks).append(row)
    term = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["_terms"], np.uint64) for r in told)])
    df = np.concatenate([np.zeros(0, np.int64), *(_unpack(r["_df"]) for r in told)])
    known, where = np.unique(term, return_inverse=True)
    total = np.bincount(where, df, len(known)).astype(np.int64)
    found = [total[np.searchsorted(known, np.frombuffer(r["_terms"], np.uint64))].tobytes() for r in asks]
    return pa.Table.from_arrays(_table([(r["_query"], r["_terms"], f) for r, f in zip(asks, found, strict=True)], _QUERY), names=_QUERY.names)


def _whole(table: pa.Table) -> pa.Table:
    """The terms of one query, from all buckets, and their counts."""
    term, first = np.unique(np.frombuffer(b"".join(table.column("_terms").to_pylist()), np.uint64), return_index=True)
    df = np.frombuffer(b"".join(table.column("_df").to_pylist()), np.int64)[first]
    return pa.Table.from_arrays(_table([(table.column("_query")[0].as_py(), term.tobytes(), _pack(df))], _QUERY), names=_QUERY.names)


def _searched(queries, mean: float, k: int):
    """A task's shards, one after the other; then its hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        best = Best(len(asked.ids), k)
        for batch in batches:
            for i in range(batch.num_rows):
                Index(Postings.unpack(*(c[i].as_py() for c in batch.columns)), mean).search(asked, best)
                tidy()
        for a in range(0, len(asked.ids), 10_000):
            there = best.score[a:a + 10_000] > 0
            who = np.broadcast_to(asked.ids[a:a + 10_000, None], there.shape)[there]
            ids, none = best.ids[a:a + 10_000][there], best.none[a:a + 10_000][there]
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids, mask=none), pa.array(best.score[a:a + 10_000][there])], names=_HITS.names)
        tidy()

    return run


def top_k(docs: DataFrame, key: str, text: str, is_query: Column, k: int = 10, shard_bytes: int = SHARD, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each row where ``is_query`` holds, its whole text as a query: ``query_id``, ``rank``
    (from 1), ``doc_id`` and the BM25 ``score`` of the ``k`` best rows with a word of it, the
    row itself included. Ties go to the smaller key, null keys last; repeated rows are hits of
    their own. ``key`` is a whole number. A query without words (a null text too), or with a null key, has no hits. Rows of one key that
    are queries together ask once, with the words of all their texts. An empty table has no hits. Other
    columns of ``docs``, whatever their names, are not read.

    Bounds: a task holds a shard (``shard_bytes`` of text and one text more) and a block of
    queries (``query_bytes`` of terms and one query more), which is what is broadcast and what the driver sees. The
    index is read once per block of queries, the texts once.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"), F.coalesce(is_query, F.lit(False)).alias("_asks"))
    total = input_bytes(base, "_text")
    buckets = min(pieces(total, 1 << 25, 6), MOST_PARTITIONS)
    rows = base.select("_id", "_text", F.when(F.col("_asks"), F.col("_id")).alias("_query"))
    rows = rows.coalesce(pieces(total, shard_bytes, spark.sparkContext.defaultParallelism))  # many small files don't become many small shards
    indexed = stored(rows.mapInArrow(_read(buckets, shard_bytes), _PASS), "postings")
    shards = indexed.where("_bucket = -1")
    answers = indexed.where("_bucket >= 0").select("_bucket", *_QUERY.names).groupBy("_bucket").applyInArrow(of_group(_answer), _QUERY)
    answers = stored(answers.groupBy("_query").applyInArrow(_whole, _QUERY), "queries")
    asked = answers.agg(F.sum(F.octet_length("_terms"))).first()[0] or 0
    blocks = max(1, -(-asked // query_bytes))
    n, words = shards.agg(F.sum(F.octet_length("_ids")), F.sum("_words")).first()
    n, hits = (n or 0) // 8, scratch_path(spark, "hits")
    mean = (words or 0) / max(1, n)
    answers = answers.withColumn("_block", F.pmod(F.xxhash64("_query"), F.lit(blocks)))
    if blocks > 1:  # a block's queries are then read without the others
        path = scratch_path(spark, "blocks")
        answers.repartition("_block").write.partitionBy("_block").parquet(path)
        answers = spark.read.parquet(path)
    for b in range(blocks):
        some = answers.where(F.col("_block") == b).collect()  # bounded by query_bytes
        some = Queries([r["_query"] for r in some], [np.frombuffer(r["_terms"], np.uint64) for r in some], [_unpack(r["_df"]) for r in some], n)
        shared = spark.sparkContext.broadcast(some)
        shards.select([f.name for f in _SHARD]).mapInArrow(_searched(shared, mean, k), _HITS).write.mode("append").parquet(hits)
        shared.unpersist()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = spark.read.schema(_HITS).parquet(hits).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op4_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document, by doc_id, as a query against all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return top_k(docs, "doc_id", "text", F.col("doc_id") % 100 == 0)
