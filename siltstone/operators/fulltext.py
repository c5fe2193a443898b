"""Full-text search: relevance, boolean terms and query expansion.

Relevance is a sum over the query's words of the word's weight in the row times its
weight in the table: a row's weight is ``(ln tf + 1) / sum(ln tf + 1) * u / (1 + 0.0115 u)``
with ``u`` distinct words in the row, a table's ``ln((N - df) / df)``. Words of half of the
rows and more weigh nothing. ``relevance`` reads the texts; ``build_index`` stores every word's rows with
their weights once, and ``search_index`` reads those of the query's words.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pivot of the length norm, and the letters of the shortest and the longest word.
PIVOT, SHORTEST, LONGEST = 0.0115, 4, 84


def words(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The words of a text, lowered: letters, digits and underscores, quotes inside a word."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)*)"), 1)
    return F.filter(found, lambda w: F.length(w).between(shortest, longest))


def _begins(start: str):
    return lambda w: w.startswith(start)


def _holds(text: Column, word: str) -> Column:
    """Whether a lowered word is among the words of a text, without making a list of them."""
    if not re.fullmatch(r"[^\W]+(?:'\w+)*", word) or len(word) > LONGEST:
        return F.lit(False)
    low, letter = F.lower(text), r"[\p{L}\p{N}_]"
    return low.contains(word) & low.rlike(f"(?<!{letter})(?<!{letter}')" + re.escape(word) + f"(?!{letter})(?!'{letter})")


def relevance(df: DataFrame, key: str, text: str, query: str, stopwords: tuple[str, ...] = (), shortest: int = SHORTEST) -> DataFrame:
    """``key`` and ``score`` of the rows with a score above zero. No row is shuffled: the words'
    counts are one row. Only rows with a query's word are cut into words."""
    wanted = sorted({w for w in re.findall(r"[^\W]+(?:'\w+)*", query.lower()) if shortest <= len(w) <= LONGEST} - set(stopwords))
    if not wanted:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    some = reduce(lambda a, b: a | b, [_holds(F.col(text), w) for w in wanted])
    found = words(F.col(text), shortest)
    listed = df.where(some).select(F.col(key), (F.filter(found, lambda w: ~w.isin(list(stopwords))) if stopwords else found).alias("_w"))
    distinct = F.array_distinct("_w")
    tf = lambda w: F.size(F.filter("_w", lambda x: x == w))
    # equal words side by side: one pass gives the sum over the words of ln tf + 1
    run_end = lambda s: F.when(s["run"] > 0, F.log(s["run"].cast("double")) + 1.0).otherwise(0.0)
    norm = F.aggregate(
        F.sort_array("_w"), F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0.0).alias("sum")),
        lambda s, w: F.struct(w.alias("word"), F.when(w == s["word"], s["run"] + 1).otherwise(1).alias("run"),
                              F.when(w == s["word"], s["sum"]).otherwise(s["sum"] + run_end(s)).alias("sum")),
        lambda s: s["sum"] + run_end(s))
    hits = F.filter(F.array(*[F.struct(F.lit(w).alias("word"), tf(F.lit(w)).alias("tf")) for w in wanted]), lambda s: s["tf"] > 0)
    rows = listed.select(key, F.size(distinct).alias("_u"), hits.alias("_h"), norm.alias("_norm"))
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(_holds(F.col(text), w)).alias(f"_d{i}") for i, w in enumerate(wanted)])
    weights = F.create_map(*[x for i, w in enumerate(wanted) for x in (F.lit(w), F.when((F.col(f"_d{i}") > 0) & (F.col("_n") > F.col(f"_d{i}")), F.greatest(
        F.log((F.col("_n") - F.col(f"_d{i}")) / F.col(f"_d{i}")), F.lit(0.0))).otherwise(0.0))])
    one = counts.select(weights.alias("_g"))
    joined = rows.crossJoin(F.broadcast(one))  # one row on the right
    local = lambda s: (F.log(s["tf"].cast("double")) + 1.0) / F.col("_norm") * F.col("_u") / (1.0 + PIVOT * F.col("_u"))
    score = F.aggregate("_h", F.lit(0.0), lambda a, s: a + local(s) * F.element_at("_g", s["word"]))
    return joined.select(key, score.alias("score")).where("score > 0")


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Buckets of words of an index.
BUCKETS = 64


def build_index(df: DataFrame, key: str, text: str, path: str, stopwords: tuple[str, ...] = (), shortest: int = SHORTEST) -> None:
    """Store the words' rows: ``postings`` by bucket and word with the word's weight in the row, and ``rows``, how many the table has.
    Texts are cut into words where they lie; a word of many rows fills several files."""
    found = words(F.col(text), shortest)
    found = F.array_sort(F.filter(found, lambda w: ~w.isin(list(stopwords))) if stopwords else found)

    def runs(w: Column) -> Column:
        """Sorted words into words with counts: equal ones stand side by side, from where each begins to where the next does."""
        begin = F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1))))
        return _let(begin, lambda s: F.transform(s, lambda i, n: F.struct(F.get(w, i).alias("word"), (F.coalesce(F.get(s, n + 1), F.size(w)) - i).alias("tf"))))

    def weighed(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + F.log(x["tf"].cast("double")) + 1.0)
        return _let(total, lambda t: F.transform(c, lambda x: F.struct(
            x["word"].alias("word"), ((F.log(x["tf"].cast("double")) + 1.0) / t * F.size(c) / (1.0 + PIVOT * F.size(c))).alias("weight"))))

    told = _let(found, lambda w: _let(runs(w), weighed))
    rows = df.select(F.col(key).alias("key"), F.explode(told).alias("x")).select("x.word", "key", "x.weight")
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    placed = rows.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "word")
    placed.write.partitionBy("bucket").parquet(f"{path}/postings")
    df.agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/rows")


def search_index(spark, path: str, query: str, key: str = "key", shortest: int = SHORTEST) -> DataFrame:
    """As ``relevance``, from an index: only the buckets, row groups and rows of the query's words are read."""
    wanted = sorted({w for w in re.findall(r"[^\W]+(?:'\w+)*", query.lower()) if shortest <= len(w) <= LONGEST})
    postings = spark.read.parquet(f"{path}/postings")
    if not wanted:
        return postings.select(F.col("key").alias(key), F.lit(0.0).alias("score")).limit(0)
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "word string").select(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    own = postings.where(F.col("bucket").isin(buckets) & F.col("word").isin(wanted))
    n = spark.read.parquet(f"{path}/rows").select(F.col("n").alias("_n"))
    df = own.groupBy("word").agg(F.count(F.lit(1)).alias("_d")).join(F.broadcast(n))  # one row on the right
    weight = F.when(F.col("_n") > F.col("_d"), F.greatest(F.log((F.col("_n") - F.col("_d")) / F.col("_d")), F.lit(0.0))).otherwise(0.0)
    told = df.select(F.col("word").alias("_word"), weight.alias("_g"))  # a row for each of the query's words
    scored = own.join(F.broadcast(told), F.col("word") == F.col("_word")).groupBy(F.col("key").alias(key)).agg(F.sum(F.col("weight") * F.col("_g")).alias("score"))
    return scored.where("score > 0")


#: What each ``>`` and ``<`` multiplies a term's weight by, how many of them count, and the weight of a term with ``~``.
STEP, MOST_STEPS, NEGATED = 1.5, 5, -0.5


def parse(query: str) -> list:
    """A boolean query as terms: (signs, kind, what), kind being word, start, phrase or group. Closing brackets without an
    opening one are left out; a group or phrase that isn't closed ends with the query."""
    def terms(i: int, inside: bool) -> tuple[list, int]:
        out, signs = [], ""
        while i < len(query):
            c = query[i]
            if c == ")" and inside:
                return out, i + 1
            if c == "(":
                found, i = terms(i + 1, True)
                out.append((signs, "group", found))
                signs = ""
            elif c == '"':
                end = query.find('"', i + 1)
                end = len(query) if end < 0 else end
                if words_ := _WORD.findall(query[i + 1:end].lower()):
                    out.append((signs, "phrase", words_))
                signs, i = "", end + 1
            elif c in "+-><~":
                signs += c
                i += 1
            elif m := _WORD.match(query, i):
                i = m.end()
                start = i < len(query) and query[i] == "*"
                out.append((signs, "start" if start else "word", m[0].lower()))
                signs, i = "", i + start
            else:
                signs, i = "", i + 1
        return out, i

    return terms(0, False)[0]


_WORD = re.compile(r"[^\W]+(?:'\w+)*")


def _term(text: Column, kind: str, what) -> tuple[Column, Column]:
    """Whether a text has a term, and the term's weight there before its signs."""
    if kind == "group":
        return _group(text, what)
    if kind == "phrase":
        test = F.lower(text).rlike(r"(?<![\p{L}\p{N}_])" + r"[^\p{L}\p{N}_]+".join(map(re.escape, what)) + r"(?![\p{L}\p{N}_])")
    elif kind == "start":
        test = F.lower(text).contains(what) & F.exists(words(text, 1), _begins(what))
    else:
        test = _holds(text, what)
    return F.coalesce(test, F.lit(False)), F.lit(1.0)


def _group(text: Column, terms: list) -> tuple[Column, Column]:
    """Whether a text has a group of terms, and its weight: the mean of the ``+`` terms' and the sum of the others'."""
    must, must_not, may = [], [], []
    for signs, kind, what in terms:
        there, weight = _term(text, kind, what)
        steps = max(-MOST_STEPS, min(MOST_STEPS, signs.count(">") - signs.count("<")))
        factor = STEP**steps * (NEGATED if signs.count("~") % 2 else 1.0)
        side = "-" if "-" in signs else "+" if "+" in signs else ""
        {"+": must, "-": must_not, "": may}[side].append((there, weight * factor))
    keep = F.lit(bool(must or may))
    for there, _ in must:
        keep = keep & there
    for there, _ in must_not:
        keep = keep & ~there
    if not must and may:
        keep = keep & reduce(lambda a, b: a | b, [there for there, _ in may])
    weight = sum((F.when(there, w).otherwise(0.0) / len(must) for there, w in must), F.lit(0.0))
    weight = sum((F.when(there, w).otherwise(0.0) for there, w in may), weight)
    return keep, weight


def boolean(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """``key`` and ``score`` of the rows that a boolean query accepts. ``+word`` must be there,
    ``-word`` must not, ``word*`` is a beginning, ``"a phrase"`` stands together, ``(a group)`` is a query of its own, a bare word
    adds to the score. ``>`` and ``<`` raise and lower a term's weight, ``~`` makes it negative. Without a ``+`` term, one of the bare ones must be
    there. The required terms of a group share one weight. No shuffle."""
    keep, weight = _group(F.col(text), parse(query))
    return df.where(keep).select(key, weight.alias("score"))


def expand(df: DataFrame, key: str, text: str, query: str, rows: int = 20, terms: int = 10, **more) -> DataFrame:
    """Relevance of the query with the most frequent words of its ``rows`` best rows added: blind query expansion."""
    best = relevance(df, key, text, query, **more).orderBy(F.desc("score"), key).limit(rows)
    found = (df.join(F.broadcast(best.select(F.col(key).alias("_k"))), df[key] == F.col("_k"))
             .select(F.explode(F.array_distinct(words(F.col(text)))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(terms).collect())
    return relevance(df, key, text, " ".join([query, *(r["w"] for r in found)]), **more)
