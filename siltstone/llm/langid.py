"""Language identification by language-bitmask n-gram filters.

Each n-gram of four bytes has a few slots in one table; a slot holds a bit per language, so
that the ``and`` of an n-gram's slots is the set of languages whose Bloom filter contains it.
A text's n-grams are counted per language, the counts are corrected for the filters' false
positives, and the largest share decides. A slot is a word of up to 64 bits; for more
languages there are more tables, one for each 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Bytes of an n-gram, slots of the filter table, slots of an n-gram.
NGRAM, SLOTS, HASHES = 4, 1 << 20, 2
#: Fitting: so many texts of a language at most, none longer than so many bytes, so many bytes in all; an n-gram is learnt from so many occurrences on.
PER_LANGUAGE, FIT_BYTES, LANGUAGE_BYTES, LEAST = 1000, 1 << 16, 1 << 22, 2
#: A language contains an n-gram if its rate there is at least this part of the rate in the language that has it most: texts quote other languages.
COMMON = 0.05
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_SPACED = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _bytes(text: str) -> bytes:
    """Lower case; each ASCII byte that is no letter becomes a blank; blanks at both ends."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" "


def _grams(joined: np.ndarray) -> np.ndarray:
    wide = joined.astype(np.uint32)
    return wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    shift = np.uint32(32 - (SLOTS - 1).bit_length())
    return [(grams * np.uint32(m)) >> shift for m in (2654435761, 2246822519)[:HASHES]]


def _blocks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in blocks of about ``most`` bytes: the first text's number, all n-grams and where each text's begin.
    Of n-grams that reach over a text's end or lie in a run of blanks the number is 0."""
    i = 0
    while i < len(texts):
        first, parts, size = i, [], 0
        while i < len(texts) and (not parts or size < most):
            parts.append(_bytes(texts[i]) + b"\0\0\0")
            size += len(parts[-1])
            i += 1
        joined = np.frombuffer(b"".join(parts) + b"\0\0\0", np.uint8)
        grams = _grams(joined)
        grams[(joined[3:] == 0) | (joined[2:-1] == 0) | (joined[1:-2] == 0) | (joined[:-3] == 0) | (grams & 0xFFFF == 0x2020)] = 0
        yield first, grams, np.cumsum([0, *map(len, parts)])[:-1]


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts and how often each occurs."""
    found = [np.unique(g[g != 0], return_counts=True) for _, g, _ in _blocks(texts)]
    grams, where = np.unique(np.concatenate([np.zeros(0, np.uint32), *(g for g, _ in found)]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([np.zeros(0), *(n for _, n in found)]), len(grams))


class LanguageFilter:
    """The languages, the tables of bitmasks (64 languages each) and each language's rate of false positives.

    ``counted`` has each language's n-grams with how often they occur."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counted)
        self.false = np.zeros(len(self.languages))
        every = np.unique(np.concatenate([np.zeros(0, np.uint32), *(g for g, _ in counted.values())]))
        most = np.zeros(len(every))
        for grams, counts in counted.values():
            where = np.searchsorted(every, grams)
            most[where] = np.maximum(most[where], counts / max(1, counts.sum()))
        self.tables = []
        for first in range(0, len(self.languages), 64):
            some = self.languages[first:first + 64]
            kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(some) <= bits)
            table = np.zeros(SLOTS, kind)
            for bit, language in enumerate(some):
                grams, counts = counted[language]
                own = counts / max(1, counts.sum()) >= COMMON * most[np.searchsorted(every, grams)]
                for slots in _slots(grams[(counts >= LEAST) & own]):
                    table[slots] |= kind(1 << bit)
                self.false[first + bit] = np.mean((table >> kind(bit)) & kind(1)) ** HASHES
            self.tables.append(table)

    @classmethod
    def of(cls, samples: dict[str, list[str]]) -> LanguageFilter:
        return cls({language: _counted(texts) for language, texts in samples.items()})

    def contains(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        """For each language, which n-grams its filter contains; 0 is no n-gram."""
        slots, none = _slots(grams), grams == 0
        for first, table in zip(range(0, len(self.languages), 64), self.tables, strict=True):
            sets = table[slots[0]]
            for s in slots[1:]:
                sets &= table[s]
            sets[none] = 0
            for bit in range(min(64, len(self.languages) - first)):
                yield (sets >> sets.dtype.type(bit)) & sets.dtype.type(1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and a score from 0 to 1, the corrected share of the language's n-grams; ``und`` and 0 for
        nulls, texts without a letter and a filter without languages. Ties go to the first language by name."""
        known = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for first, grams, starts in _blocks([texts[i] for i in known]):
            n = np.maximum(np.add.reduceat(grams != 0, starts, dtype=np.int64), 1)
            share = np.stack([np.add.reduceat(found, starts, dtype=np.int64) for found in self.contains(grams)], 1) / n[:, None]
            share = np.clip((share - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)
            best = share.argmax(1)
            for k, b in enumerate(best):
                names[known[first + k]] = self.languages[b]
                scores[known[first + k]] = share[k, b]
        return names, scores


def fit(docs: DataFrame, text: str, lang: str, learn: Column, per_language: int = PER_LANGUAGE) -> LanguageFilter:
    """A filter from the rows where ``learn`` holds and language and text are there: of each language about
    ``per_language`` distinct texts, those with the smallest hashes, of at most ``FIT_BYTES`` bytes each and about ``LANGUAGE_BYTES``
    together. The share of the hashes that is taken falls as the corpus grows, so that bound holds at any size. The driver
    sees one language's texts after the other's, and keeps their n-grams."""
    rows = (docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= FIT_BYTES))
            .select(F.col(lang).alias("_l"), F.xxhash64(text).alias("_h"), F.col(text).alias("_t")))
    sizes = rows.groupBy("_l").agg(F.approx_count_distinct("_h").alias("n"), F.avg(F.octet_length("_t")).alias("each"))
    wanted = sizes.select("_l", F.least(F.lit(float(per_language)), LANGUAGE_BYTES / F.greatest("each", F.lit(1.0))).alias("wanted"), "n")
    # a row per language; the share of the hashes as a bound that they stay below
    bound = wanted.select(F.col("_l").alias("_b"), F.when(F.col("n") <= F.col("wanted"), F.lit((1 << 63) - 1)).otherwise(
        (F.col("wanted") / F.col("n") * 2.0**64 - 2.0**63).cast("long")).alias("_most"))
    chosen = rows.join(F.broadcast(bound), (F.col("_l") == F.col("_b")) & (F.col("_h") <= F.col("_most")))
    texts = chosen.groupBy("_l", "_h").agg(F.min("_t").alias("_t")).orderBy("_l", "_h")
    counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for language, some in groupby(texts.toLocalIterator(), key=lambda r: r[0]):
        counted[language] = _counted([r[2] for r in some])
    return LanguageFilter(counted)


def predict(docs: DataFrame, text: str, model: LanguageFilter, out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``out`` and ``score``; all rows and other columns stay. Whole texts, no shuffle.
    Columns already of these names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 8 MB for each 64 languages, whatever the corpus
    place = docs.columns.index(text)
    schema = docs.select("*", F.lit("").alias(out), F.lit(0.0).alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)
        tidy()

    return docs.mapInArrow(run, schema)


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text falls into ``part``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a fifth of the documents, by doc_id, is never learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, "text", "lang", ~held_out("doc_id", 5, 0))
    found = predict(docs.select("doc_id", "text"), "text", model)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
