"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows for the word and for its beginnings, so that
inflected forms share what they have in common. Filters of several widths slide over the
words; the maximum of each over the whole text feeds a logistic layer. Thresholds are found
per language, the language being told by the text's own function words, and the score is
shifted so that each language's threshold lies at the same place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, smallest_hashes, tidy
from .langid import held_out

#: Rows of the embedding table, numbers in a row, filters of each width, widths in words, letters of a word's beginnings.
ROWS, DIMENSIONS, FILTERS, WIDTHS, BEGINNINGS = 1 << 15, 16, 8, (1, 2, 3), (4, 5)
#: Fitting: texts of each label at most, bytes of the longest; passes and steps at least, texts of a step, step size.
PER_LABEL, FIT_BYTES, PASSES, STEPS, STEP_TEXTS, STEP = {0: 3000, 1: 2000}, 1 << 14, 6, 500, 32, 0.02
#: Where every language's threshold lies on the scale of scores.
THRESHOLD = 0.3
#: Frequent function words that tell the language of a text.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit den zu ein auf sich",
    "en": "the and of to in is that it was for with be",
    "es": "el los las y es del que en por una se con",
    "fr": "le la les et est des que dans pour une au sur",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_TOLD = {w.encode(): [i for i, k in enumerate(FUNCTION_WORDS) if w in FUNCTION_WORDS[k].split()] for ws in FUNCTION_WORDS.values() for w in ws.split()}
_SPACED = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
#: Blank words behind each text. Filters start at its words and at the first of these, and so never reach into the next text.
PAD = max(WIDTHS)


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def rows_of(word: bytes) -> list[int]:
    """Rows of the embedding table: 1 and up; row 0 is the blank word's."""
    letters = word.decode("utf-8", "replace")
    parts = [word, *(b"^%d" % n + letters[:n].encode("utf-8", "replace") for n in BEGINNINGS)]
    return [1 + zlib.crc32(p) % (ROWS - 1) for p in parts]


class Classifier:
    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.table = draw.normal(0, 0.02, (ROWS, DIMENSIONS)).astype(np.float32)
        self.table[0] = 0
        self.filters = [draw.normal(0, 0.3, (k, DIMENSIONS, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = draw.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.thresholds = dict.fromkeys(LANGUAGES, 0.0)

    def fit(self, texts: list[list[bytes]], labels: np.ndarray, seed: int = 7) -> None:
        """Adam on the logistic loss, classes weighted to the same sum; only the maxima of the filters pass gradients on."""
        parameters = [self.table, *self.filters, self.bias, self.out, self.offset]
        first, second, steps = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
        known: dict[bytes, list[int]] = {}
        coded = [np.array([known.setdefault(w, None) or known.__setitem__(w, rows_of(w)) or known[w] for w in t] + [[0] * 3] * PAD, np.int32) for t in texts]
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        draw = np.random.default_rng(seed)
        for _ in range(max(PASSES, -(-STEPS * STEP_TEXTS // max(1, len(coded))))):
            order = draw.permutation(len(coded))
            for i in range(0, len(order), STEP_TEXTS):
                pick = order[i:i + STEP_TEXTS]
                ids = np.concatenate([coded[j] for j in pick])
                ends = np.cumsum([len(coded[j]) for j in pick])
                starts = ends - [len(coded[j]) for j in pick]
                x = self.table[ids].sum(1)
                pooled, at = [], []
                for k, f in zip(WIDTHS, self.filters, strict=True):
                    y = x @ f[0]
                    for o in range(1, k):
                        y[:-o] += x[o:] @ f[o]
                    best = np.stack([s + y[s:e - PAD + 1].argmax(0) for s, e in zip(starts, ends, strict=True)])
                    at.append(best)
                    pooled.append(np.take_along_axis(y, best, 0))
                raw = np.concatenate(pooled, 1) + self.bias
                hidden = np.maximum(raw, 0)
                p = 1 / (1 + np.exp(-(hidden @ self.out + self.offset)))
                d = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
                back = (d[:, None] * self.out) * (raw > 0)
                table = np.zeros_like(self.table)
                grads = [table]
                for n, (k, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    b, g = back[:, n * FILTERS:(n + 1) * FILTERS], np.zeros_like(f)
                    for o in range(k):
                        where = np.minimum(at[n] + o, len(x) - 1)
                        g[o] = np.einsum("tfd,tf->df", x[where], b)
                        passed = b[:, :, None] * f[o].T[None]
                        for r in range(ids.shape[1]):
                            np.add.at(table, ids[where, r], passed)
                    grads.append(g)
                table[0] = 0
                grads += [back.sum(0), hidden.T @ d, np.array([d.sum()], np.float32)]
                steps += 1
                for q, g, m, v in zip(parameters, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= STEP * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)

    def calibrate(self, texts: list[list[bytes]], labels: np.ndarray) -> None:
        """Per language the threshold of the best F1, in the middle of the gap where it holds; a language without
        both labels gets that of all texts."""
        logits, told = Scorer(self).logits(texts)
        every = _best(logits, labels)
        for i, name in enumerate(LANGUAGES):
            own = told == i
            both = own.any() and 0 < labels[own].sum() < own.sum()
            self.thresholds[name] = _best(logits[own], labels[own]) if both else every


def _best(logits: np.ndarray, labels: np.ndarray) -> float:
    order = np.argsort(-logits, kind="stable")
    x, y = logits[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    k = int(f1.argmax()) if len(y) else 0
    return float((x[k] + x[k + 1]) / 2) if k + 1 < len(x) else float(x[k] - 1) if len(x) else 0.0


class Scorer:
    """Scores texts; a word's share in every filter is worked out once and kept."""

    KEPT = 200_000

    def __init__(self, model: Classifier):
        self.model = model
        self.wide = np.concatenate([f.transpose(1, 0, 2).reshape(DIMENSIONS, -1) for f in model.filters], 1)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {b"": 0}
        self.shares = np.zeros((1 << 12, self.wide.shape[1]), np.float32)
        self.told = np.zeros((1 << 12, len(FUNCTION_WORDS)), np.int32)

    def _learn(self, new: list[bytes]) -> None:
        n = len(self.places)
        while len(self.shares) < n + len(new):
            self.shares = np.concatenate([self.shares, np.zeros_like(self.shares)])
            self.told = np.concatenate([self.told, np.zeros_like(self.told)])
        for i, w in enumerate(new):
            self.places[w] = n + i
            for k in _TOLD.get(w, ()):
                self.told[n + i, k] = 1
        ids = np.array([rows_of(w) for w in new])
        self.shares[n:n + len(new)] = self.model.table[ids].sum(1) @ self.wide

    def logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the classifier's logit and the number of its language in LANGUAGES."""
        found, told, i = [], [], 0
        while i < len(texts):
            block, size = [], 0
            while i < len(texts) and (not block or size < 1 << 15):
                block.append(texts[i])
                size += len(texts[i]) + PAD
                i += 1
            if len(self.places) > self.KEPT:
                self._forget()
            new = set().union(*block) - self.places.keys()
            if new:
                self._learn(sorted(new))
            blank = [0] * PAD
            ids = np.array([p for t in block for p in (*map(self.places.__getitem__, t), *blank)])
            lengths = np.array([len(t) + PAD for t in block])
            starts = np.cumsum(lengths) - lengths
            shares, pooled, column = self.shares[ids], [], 0
            for k in WIDTHS:
                y = shares[:, column:column + FILTERS].copy()
                for o in range(1, k):
                    y[:-o] += shares[o:, column + o * FILTERS:column + (o + 1) * FILTERS]
                column += k * FILTERS
                for o in range(1, PAD):
                    y[starts + lengths - o] = -np.inf
                pooled.append(np.maximum.reduceat(y, starts, 0))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.model.bias, 0)
            found.append(hidden @ self.model.out + self.model.offset)
            count = np.add.reduceat(self.told[ids], starts, 0)
            told.append(np.where(count.max(1) > 0, count.argmax(1), len(FUNCTION_WORDS)))
        return (np.concatenate(found), np.concatenate(told)) if found else (np.zeros(0), np.zeros(0, int))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A text without a word scores 0."""
        split = [words(t) for t in texts]
        logits, told = self.logits(split)
        shift = np.array([self.model.thresholds[k] for k in LANGUAGES])[told] - np.log(THRESHOLD / (1 - THRESHOLD))
        return np.where([bool(t) for t in split], 1 / (1 + np.exp(-np.clip(logits - shift, -60, 60).astype(float))), 0.0)


def fit(docs: DataFrame, text: str, key: str, labels: DataFrame, label: str, learn: Column) -> Classifier:
    """A classifier from the labelled rows where ``learn`` holds: of each label about
    ``PER_LABEL`` distinct texts, those with the smallest hashes, at most ``FIT_BYTES`` bytes
    long; the share taken falls as the corpus grows, so the bound holds at any size. Every fourth text calibrates the thresholds.
    Of several labels of one key the largest counts. Without texts of both labels, the
    classifier scores as it was drawn."""
    told = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    rows = docs.where(learn & F.col(text).isNotNull() & (F.octet_length(text) <= FIT_BYTES)).select(key, F.xxhash64(text).alias("_h"))
    one = rows.join(told, key).groupBy("_h").agg(F.max("_y").alias("_y"), F.min(key).alias(key))
    counts = {r[0]: r[1] for r in one.groupBy("_y").agg(F.count(F.lit(1))).collect()}
    chosen = one.where(" or ".join(f"(_y = {y} and _h <= {smallest_hashes(n, counts.get(y, 0))})" for y, n in PER_LABEL.items()))
    small = F.broadcast(chosen.select(F.col(key).alias("_k"), "_h", "_y"))  # about the sum of PER_LABEL rows
    full = docs.join(small, (docs[key] == F.col("_k")) & (F.xxhash64(docs[text]) == F.col("_h")))
    sample = full.groupBy("_h", "_y").agg(F.min(text).alias("_t")).collect()
    sample.sort(key=lambda r: r[0])
    texts, y = [words(r[2]) for r in sample], np.array([r[1] for r in sample], np.float32)
    model = Classifier()
    if len(set(y.tolist())) == 2:
        held = np.arange(len(y)) % 4 == 3
        model.fit([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
        model.calibrate([t for t, h in zip(texts, held, strict=True) if h], y[held])
    return model


def score(docs: DataFrame, text: str, model: Classifier, out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (null and texts without a word: 0). All rows and other columns stay; a column of
    the name ``out`` is replaced. No shuffle."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 2 MB, whatever the corpus
    place, schema = docs.columns.index(text), docs.select("*", F.lit(0.0).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = scorer.scores(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=schema.names)
        tidy()

    return docs.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; a quarter of the labels, by doc_id, is never learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, "text", "doc_id", labels, "toxic", ~held_out("doc_id", 4, 2))
    return score(docs, "text", model).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
