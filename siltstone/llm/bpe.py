"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens. A chunk of texts keeps its own dictionary, so that a text is
a list of small numbers and each word of a chunk is sent once. The dictionaries' words are
dealt by their hash: equal words of all chunks meet in one task, which encodes each distinct
word once. The ids go back to the chunks, and every text is put together by the places of
its words. Decoding joins the table of the tokens' bytes.

Words travel packed, a row for each chunk and bucket of words; what one task holds is one
chunk, bounded by ``CHUNK`` bytes of text and one text more, or one bucket's distinct words.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_PARTITIONS, bucketed, input_bytes, of_groups, pieces, tidy

#: Bytes of text that share a dictionary.
CHUNK = 1 << 24
#: The letters and blanks below U+0250, and the characters that send a text to the general pattern.
_LETTERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", " \\t-\\r\\xa0"
_OTHER = re.compile("[²³¹¼-¾\u0085ɐ-\U0010ffff]")


class Splitter:
    """Splits texts by a pattern as the pattern's own library does. Texts of letters below
    U+0250 go through an equal pattern of plain character classes, which is several times faster."""

    def __init__(self, pattern: str):
        self.general = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_BLANKS}{_LETTERS}0-9]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")
        plain = plain.replace(r"\s", f"[{_BLANKS}]").replace(r"\S", f"[^{_BLANKS}]")
        self.plain = None if r"\p" in plain else re.compile(plain)

    def __call__(self, text: str) -> list[str]:
        if self.plain is not None and not _OTHER.search(text):
            return self.plain.findall(text)
        return self.general.findall(text)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32, byte planes apart, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_WORDS = T.StructType([T.StructField("_chunk", T.LongType()), T.StructField("_bucket", T.IntegerType()),
                       T.StructField("_places", T.BinaryType()), T.StructField("_packed", T.BinaryType())])


def _split_texts(pattern: str, place: int, buckets: int, names: list[str], kinds: pa.Schema):
    """Rows of texts become rows of numbers, and each chunk's dictionary follows in packed rows."""
    word_kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, numbers, size = Splitter(pattern), _Numbers(), 0
        chunk = TaskContext.get().partitionId() << 32

        def dictionary() -> pa.RecordBatch | None:
            rows: dict[int, list[int]] = {}
            words = [w.encode("utf-8", "replace") for w in numbers]
            for i, w in enumerate(words):
                rows.setdefault(zlib.crc32(w) % buckets, []).append(i)
            keys = sorted(rows)
            columns = [pa.nulls(len(keys), k.type) for k in kinds]
            columns += [pa.nulls(len(keys), pa.binary()), pa.array([chunk] * len(keys), word_kinds[0]), pa.array(keys, word_kinds[1]),
                        pa.array([pack(np.diff(rows[b], prepend=0)) for b in keys], word_kinds[2]),
                        pa.array([pack_words([words[i] for i in rows[b]]) for b in keys], word_kinds[3])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                blobs = []
                for text in part.column(place).to_pylist():
                    blobs.append(pack(np.array([numbers[w] for w in split(text or "")], np.uint32)))
                size += pc.sum(pc.binary_length(part.column(place))).as_py() or 0
                rest = [c for n, c in enumerate(part.columns) if n != place]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(blobs, pa.binary()), pa.array([chunk] * len(blobs), word_kinds[0]),
                                                  *(pa.nulls(len(blobs), k) for k in word_kinds[1:])], names=names)
                if size >= CHUNK:
                    if numbers:
                        yield dictionary()
                    numbers, size, chunk = _Numbers(), 0, chunk + 1
                    tidy()
        if numbers:
            yield dictionary()
        numbers.clear()
        tidy()

    return run


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack(np.array([len(w) for w in words], np.uint32))
    return len(lengths).to_bytes(4, "little") + lengths + zlib.compress(b"".join(words), 1)


def unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    lengths, joined = unpack(data[4:4 + n]), zlib.decompress(data[4 + n:])
    ends = np.cumsum(lengths).tolist()
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _encode_words(ranks, pattern: str):
    """Each distinct word once: words of a bucket come to one task, which remembers what it has encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["_bucket"] != bucket:  # rows come sorted by bucket
                    bucket, known = row["_bucket"], {}
                    tidy()
                counts, ids = [], []
                for word in unpack_words(row["_packed"]):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = encoder._encode_single_piece(word)
                    counts.append(len(found))
                    ids += found
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["_chunk"]], pa.int64()), pa.array([row["_bucket"]], pa.int32()), pa.array([row["_places"]], pa.binary()),
                     pa.array([pack(np.array(counts, np.uint32)) + pack(np.array(ids, np.uint32))], pa.binary()),
                     pa.array([len(pack(np.array(counts, np.uint32)))], pa.int32())],
                    names=["_chunk", "_bucket", "_places", "_ids", "_cut"])
        known.clear()
        tidy()

    return run


_IDS = T.StructType([T.StructField("_chunk", T.LongType()), T.StructField("_bucket", T.IntegerType()), T.StructField("_places", T.BinaryType()),
                     T.StructField("_ids", T.BinaryType()), T.StructField("_cut", T.IntegerType())])


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[start:start + count]`` one behind the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def _reassemble(names: list[str], out: str):
    def run(docs: pa.Table, ids: pa.Table) -> pa.Table:
        places, counts, values = [], [], []
        for row in ids.to_pylist():
            places.append(np.cumsum(unpack(row["_places"])))
            counts.append(unpack(row["_ids"][:row["_cut"]]))
            values.append(unpack(row["_ids"][row["_cut"]:]))
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        count = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
        value = np.concatenate(values) if values else np.zeros(0, np.uint32)
        start_of, count_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        start_of[place], count_of[place] = np.cumsum(count) - count, count
        found = []
        for blob in docs.column("_numbers").to_pylist():
            numbers = unpack(blob)
            found.append(_gather(value, start_of[numbers], count_of[numbers]).astype(np.int32))
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
        return pa.table([*(docs.column(n) for n in names), lists], names=[*names, out])

    return run


def encode(docs: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, out: str = "ids") -> DataFrame:
    """``docs`` without ``text`` and with ``out``, the ids of the whole text's tokens (null and
    empty text: no ids). Every row and other column stays; columns of the names that the
    operator needs (``out``, ``_chunk``, ``_bucket``, ``_places``, ``_packed``, ``_numbers``) are replaced."""
    spark = docs.sparkSession
    docs = docs.drop(out, *(c for c in (*_WORDS.names, "_numbers") if c != text))
    buckets = pieces(input_bytes(docs, text), CHUNK)
    rest = [f for f in docs.schema.fields if f.name != text]
    rest = [T.StructField(f.name, f.dataType, True) for f in rest]
    schema = T.StructType([*rest, T.StructField("_numbers", T.BinaryType()), *_WORDS.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T.StructType(rest))
    run = _split_texts(pattern, docs.columns.index(text), buckets, schema.names, kinds)
    # a chunk comes from one task, so the texts can be laid out by chunk where they are
    split = bucketed(docs.mapInArrow(run, schema), "_chunk", 2 * buckets, "pretokens", deal=False)
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary, whatever the corpus
    words = split.where("_packed is not null").select(_WORDS.names).repartition(min(buckets, MOST_PARTITIONS), "_bucket").sortWithinPartitions("_bucket")
    ids = words.mapInArrow(_encode_words(shared, pattern), _IDS)
    texts = split.where("_numbers is not null").select(*[f.name for f in rest], "_numbers", "_chunk")
    result = T.StructType([*rest, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return texts.groupBy("_chunk").cogroup(ids.groupBy("_chunk")).applyInArrow(of_groups(_reassemble([f.name for f in rest], out)), result)


def decode_ids(ids: list[int], table: dict[int, bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def decode(docs: DataFrame, ids: str, ranks: dict[bytes, int], out: str = "decoded", digest: str | None = None) -> DataFrame:
    """``docs`` with the bytes of each list of ids: a join of the table of the tokens' bytes,
    which every task holds (it is the vocabulary, whatever the corpus). With ``digest``, also
    the SHA-256 of the ids as little-endian unsigned 32-bit numbers. A null list gives nulls,
    an unknown id is an error. Every row and other column stays; columns of the new names are replaced."""
    new = [out, *([digest] if digest else [])]
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast({n: b for b, n in ranks.items()})
    place = docs.columns.index(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType()), *([T.StructField(digest, T.StringType())] if digest else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = [x.values.to_numpy() if x.is_valid else None for x in part.column(place)]
                columns = [*part.columns, pa.array([None if x is None else decode_ids(x.tolist(), shared.value) for x in lists], pa.binary())]
                if digest:
                    columns.append(pa.array([None if x is None else hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        tidy()

    return docs.mapInArrow(run, schema)


#: The vocabulary of the registered query.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document and what they decode to, as digests."""
    ranks, pattern = vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decode(encode(docs, "text", ranks, pattern), "ids", ranks, digest="ids_sha256").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
