"""Document fingerprints by winnowing, in DataFrame expressions alone.

Every ``k`` words in a row are hashed; of each ``window`` hashes in a row the smallest is
chosen, the rightmost of equal ones. A run of ``window + k - 1`` words that two texts share
gives both the same chosen hash; the hash's place is kept with it.

The hash of a k-gram is a cyclic polynomial of its words' hashes, a rolling hash; as an array
expression cannot carry a state along cheaply, it is rolled by doubling: the hashes of two words in a row
from those of one, of four from those of two, and of ``k`` from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import input_bytes, pieces

#: Words of a k-gram, hashes of a window, letters of the longest word.
K, WINDOW, LONGEST = 5, 4, 32
#: The ranges of scripts that are written without blanks (Thai, Lao, Tibetan, Myanmar, Khmer, Hiragana, Katakana, Han). Each of
#: their letters is a word.
UNSPACED = (r"\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{0F00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{309F}"
            r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}")
_ANY = r"\p{L}\p{M}\p{N}"
_SPACED, _LETTER = rf"[{_ANY}&&[^{UNSPACED}]]", rf"[{_ANY}&&[{UNSPACED}]]"
#: A letter of such a script; a run of other letters and digits; each letter of a longer run.
WORD = rf"{_LETTER}|(?<!{_SPACED}){_SPACED}{{1,{LONGEST}}}+(?!{_SPACED})|{_SPACED}"
#: Bounds that are told at once, buckets and partitions of ``with_next`` at most; only the layout depends on them.
_COARSE, _BUCKETS, _PARTS = 1024, 1 << 20, 1 << 17


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _turned(h: Column, bits: int) -> Column:
    bits %= 64
    return h if bits == 0 else F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits))


def _joined(one: Column, n: int, other: Column, m: int) -> Column:
    """The hashes of ``n + m`` words in a row, from those of ``n`` and of ``m``."""
    count = F.greatest(F.size(other) - n, F.lit(0))
    return F.transform(F.slice(one, F.lit(1), count), lambda h, i: _turned(h, m).bitwiseXOR(F.get(other, i + n)))


def _rolled(words: Column, k: int, use) -> Column:
    """``use(hashes)`` with the hashes of all ``k`` words in a row, from the words' own: by doubling."""
    def step(made: Column | None, have: int, doubled: Column, w: int) -> Column:
        def further(made: Column | None, have: int) -> Column:
            if 2 * w > k:
                return use(made)
            return _let(_joined(doubled, w, doubled, w), lambda d: step(made, have, d, 2 * w))

        if not k & w:
            return further(made, have)
        if made is None:
            return further(doubled, w)
        return _let(_joined(made, have, doubled, w), lambda m: further(m, have + w))

    return step(None, 0, words, 1)


def words_of(text: Column) -> Column:
    """The words of a text, lowered: what ``WORD`` finds. Where nothing is written without blanks and no run is long, these are
    the runs of letters, marks and digits, which are found several times faster."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.filter(F.split(low, rf"[^{_ANY}]+"), lambda w: w != "")
    return _let(plain, lambda w: F.when(low.rlike(f"[{UNSPACED}]") | F.exists(w, lambda x: F.char_length(x) > LONGEST),
                                        F.regexp_extract_all(low, F.lit(WORD), F.lit(0))).otherwise(w))


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint of a whole text: an array of (pos, hash) in order of pos, the number of
    the k-gram's first word. Words are runs of letters, marks and digits, lowered; in scripts that are written without
    blanks, and in runs of over ``LONGEST``, each letter is a word. A text of fewer
    than ``k`` words is one k-gram, a text of fewer than ``window`` k-grams one window; null
    and texts without words give an empty array. ``window`` is 2 or more."""
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    every = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda s, x: _turned(s, 1).bitwiseXOR(x))

    def grams(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) <= k, F.array(every(h))).otherwise(_rolled(h, k, lambda x: x))

    def placed(g: Column) -> Column:  # of equal hashes, the smaller one is the one further right
        return F.transform(g, lambda x, i: F.struct(x.alias("hash"), (-i).alias("left")))

    def minima(p: Column) -> Column:
        last = F.greatest(F.size(p) - window, F.lit(0)) + 1
        return F.when(F.size(p) == 0, p).otherwise(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.least(*[F.get(p, i + j - 1) for j in range(window)])))

    def changed(m: Column) -> Column:
        return F.filter(m, lambda x, i: (i == 0) | (x["left"] != F.get(m, i - 1)["left"]))

    found = _let(hashes, lambda h: _let(grams(h), lambda g: _let(placed(g), lambda p: _let(minima(p), changed))))
    return F.transform(found, lambda x: F.struct((-x["left"]).alias("pos"), x["hash"].alias("hash")))


def likeness(one: Column, other: Column) -> Column:
    """Shared part of two fingerprints' distinct hashes, 0 to 1; of two empty fingerprints 1."""
    def share(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        every = F.size(a) + F.size(b) - both
        return F.when(every == 0, 1.0).otherwise(both / every)

    return _let(F.array_distinct(one["hash"]), lambda a: _let(F.array_distinct(other["hash"]), lambda b: share(a, b)))


def digest(fingerprint: Column) -> Column:
    """A short name for a fingerprint with its places."""
    return F.lower(F.hex(F.xxhash64(fingerprint)))


def _below(value: Column, bounds: Column, count: int) -> Column:
    """How many of at most ``count`` sorted bounds are below the value, by bisection."""
    steps = F.sequence(F.lit(1), F.lit(max(1, count.bit_length())))
    # value and bounds are part of the state: Spark cannot carry over a union what it knows of columns inside a lambda
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"), value.alias("v"), bounds.alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(s["b"], middle) < s["v"])
        return F.struct(F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"),
                        F.when((s["lo"] < s["hi"]) & ~below, middle).otherwise(s["hi"]).alias("hi"), s["v"].alias("v"), s["b"].alias("b"))

    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def _order(docs: DataFrame, key: str, h: Column) -> Column:
    """A number that never falls in the order of the key (nulls first) and of the hash ``h``: rows of one key can part by their
    hash, where the key is whole and below 2**52 or null."""
    k, part = F.col(key).cast("double") * 2.0**62, h.cast("double") / 4 + 2.0**61
    if isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        k = F.when(F.abs(F.col(key).cast("double")) < 2.0**52, k + part).otherwise(k)
    return F.when(F.col(key).isNull(), part * 2.0**58 - 2.0**126).otherwise(k)


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name


def with_next(docs: DataFrame, key: str, columns: list[str], derived: dict[str, Column] | None = None, *,
              text: str = "text", each: int = 1 << 24) -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``columns``: the value in the next row by ``key``, a number
    (nulls first; ties by the hash of ``text``, then as they come); the row after the last is the first. Every row and other
    column stays, of any names; columns ``next_<c>`` are replaced. An empty table gives an empty table.

    Rows are dealt into buckets of near equal size by quantiles of the key and, inside a key that many rows
    have, of the hash: bounds of the coarse buckets first, of the buckets inside each of them in a broadcast table of
    at most ``_BUCKETS`` numbers. The first row of
    each bucket also goes to the end of the bucket before it, so that no task needs more than
    its own bucket and texts are shuffled once. ``derived`` adds columns worked out after that
    shuffle; they can be among ``columns``.
    """
    docs = docs.drop(*(f"next_{c}" for c in columns))
    bucket, h, led, value = (_free(docs, n) for n in ("_bucket", "_h", "_led", "_value"))
    parts = min(pieces(input_bytes(docs, text), each), _PARTS)
    buckets = min(8 * parts, _BUCKETS)  # several to a partition, for an even load
    coarse = min(buckets, _COARSE)
    inner = -(-buckets // coarse)
    rows = docs.withColumn(h, F.coalesce(F.xxhash64(text), F.lit(0)))
    rows = rows.withColumn(value, _order(docs, key, F.col(h)))
    shares = lambda n: [i / n for i in range(1, n)]
    bounds = sorted(set(rows.agg(F.percentile_approx(value, shares(coarse), 10 * coarse)).first()[0] or []))
    rows = rows.withColumn(bucket, _below(F.col(value), F.lit(bounds).cast("array<double>") if bounds else F.array().cast("array<double>"), coarse).cast("long"))
    if inner > 1:
        some = rows.groupBy(F.col(bucket).alias("c")).agg(F.sort_array(F.array_distinct(F.percentile_approx(value, shares(inner), 10 * inner))).alias("b"))
        rows = rows.join(F.broadcast(some), F.col(bucket) == F.col("c")).withColumn(
            bucket, F.col(bucket) * inner + _below(F.col(value), F.col("b"), inner)).drop("c", "b")
    rows = rows.drop(value)
    firsts = rows.groupBy(F.col(bucket).alias("fb")).agg(F.min(F.struct(F.col(key).isNotNull().alias("there"), F.col(key).alias("k"), F.col(h).alias("h"))).alias("f"))
    every = Window.orderBy("fb")  # a row per bucket, ``_BUCKETS`` at most
    firsts = firsts.select("fb", F.col("f.k").alias("fk"), F.col("f.h").alias("fh"), F.coalesce(
        F.lag("fb").over(every), F.last("fb").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("ft"))
    f = firsts.select(*[F.col(c).alias(_free(docs, f"_{c}")) for c in firsts.columns])
    fb, fk, fh, ft = f.columns
    moved = rows.join(F.broadcast(f), (rows[bucket] == f[fb]) & rows[key].eqNullSafe(f[fk]) & (rows[h] == f[fh]))
    moved = moved.dropDuplicates([fb]).withColumn(bucket, F.col(ft)).select(*rows.columns)
    both = rows.withColumn(led, F.lit(0)).unionByName(moved.withColumn(led, F.lit(1)))
    order = Window.partitionBy(bucket).orderBy(led, F.col(key).asc_nulls_first(), h)
    dealt = both.repartition(parts, bucket)
    for name, made in (derived or {}).items():
        dealt = dealt.withColumn(name, made)
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.where(F.col(led) == 0).drop(bucket, h, led)


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of the document edited in its second half, and the places of their k-grams."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = with_next(docs, "doc_id", ["text", "f"], {"f": winnow(F.col("text"))})
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"),
                      F.expr("left(next_text, cast(floor(char_length(text) / 2) as int))"))
    told = told.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.when(half == 0, F.col("text")).otherwise(edited))
    told = told.withColumn("g", winnow(F.col("edited")))
    return told.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("f")).alias("fingerprint"),
                       digest(F.col("g")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("g")).alias("near_edited"),
                       likeness(F.col("f"), F.col("next_f")).alias("near_next"),
                       F.col("f.pos").alias("positions"), F.col("g.pos").alias("edited_positions"))
