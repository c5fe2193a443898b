"""Mixing sources to target weights by Pfair scheduling.

Time runs in slots; a slot holds one block of one source. Block ``j`` of a source of weight
``w`` may not run before its release ``floor(j / w)`` and must end by its deadline
``ceil((j + 1) / w)``. Among the released blocks the one with the earliest deadline runs. At
every slot each source has then run less than one block more or less than its weight's share.

Releases and deadlines come from the exact weights, as whole numbers, without a period or a
least weight. When a source has no blocks left, the weights of the others are scaled to sum to
one and a new phase of the schedule begins; nothing is dropped or repeated. One task works the
schedule out, slot after slot, with a number of entries in memory that is the number of
sources; rows find their slots by a join. ``phases`` is the periodic form, with weights rounded
to multiples of ``1 / quanta``; ``mix`` does not use it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked, stored

#: Slots of a period of the periodic form, and so the most sources that it can have.
QUANTA = 1024
#: Rows of a block.
BLOCK_ROWS = 8
#: Without given weights, a source's weight is its share of the rows to this power.
TEMPERATURE = 0.7


def quantise(weights: dict, quanta: int) -> dict:
    """Whole numbers of at least 1 that sum to ``quanta``, in proportion to ``weights``
    (largest remainders; ties by name)."""
    if len(weights) > quanta:
        raise ValueError(f"{len(weights)} sources do not fit a period of {quanta} slots")
    total, free = sum(weights.values()), quanta - len(weights)
    exact = {s: w / total * free for s, w in weights.items()}
    parts = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: quanta - sum(parts.values())]:
        parts[s] += 1
    return parts


def period(parts: dict, quanta: int) -> dict:
    """Per source the slots of its blocks in one period: earliest deadline first among the
    released blocks, ties by name."""
    slots: dict = {s: [] for s in parts}
    waiting = [(0, str(s), s) for s in parts]
    heapq.heapify(waiting)
    ready: list = []
    for now in range(quanta):
        while waiting and waiting[0][0] <= now:
            _, name, s = heapq.heappop(waiting)
            j = len(slots[s])
            heapq.heappush(ready, (-(-(j + 1) * quanta // parts[s]), name, s))
        deadline, name, s = heapq.heappop(ready)
        if deadline <= now:
            raise AssertionError("a block missed its deadline")
        slots[s].append(now)
        if (j := len(slots[s])) < parts[s]:
            heapq.heappush(waiting, (j * quanta // parts[s], name, s))
    return slots


def phases(blocks: dict, weights: dict, quanta: int = QUANTA) -> list[dict]:
    """The phases of a mixture: per phase its first slot and, per active source, the number of
    its first block and its slots in a period. At most one phase per source."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        parts = quantise({s: weights[s] for s in left}, quanta)
        slots = period(parts, quanta)
        ends = {s: (n - 1) // parts[s] * quanta + slots[s][(n - 1) % parts[s]] + 1 for s, n in left.items()}
        length = min(ends.values())
        out.append({"start": start, "first": {s: done[s] for s in left}, "slots": slots})
        for s in list(left):
            ran = length // quanta * parts[s] + sum(x < length % quanta for x in slots[s])
            done[s] += ran
            left[s] -= ran
            if not left[s]:
                del left[s]
        start += length
    return out


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """The blocks in the order of their slots, as source, number inside the source, and phase:
    earliest deadline first among the released blocks, ties by name."""
    exact = {s: Fraction(weights[s]) for s in blocks}
    scale = lcm(*(w.denominator for w in exact.values())) if exact else 1
    parts = {s: int(w * scale) for s, w in exact.items()}
    left, done, phase = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    while left:
        total = sum(parts[s] for s in left)
        # nothing but the first block of each source is released at once
        ready = [(-(-total // parts[s]), str(s), s is None, s, 0) for s in left]
        heapq.heapify(ready)
        waiting: list = []
        now, ended = 0, False
        while not ended:
            while waiting and waiting[0][0] <= now:
                _, name, none, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // parts[s]), name, none, s, j))
            deadline, name, none, s, j = heapq.heappop(ready)
            if deadline <= now:
                raise AssertionError("a block missed its deadline")
            yield s, done[s], phase
            done[s] += 1
            left[s] -= 1
            now += 1
            heapq.heappush(waiting, ((j + 1) * total // parts[s], name, none, s, j + 1))
            if not left[s]:
                del left[s]
                ended = True
        phase += 1


_SLOTS = T.StructType([T.StructField("_s", T.StringType()), T.StructField("mix_block", T.LongType()), T.StructField("mix_phase", T.IntegerType()),
                       T.StructField("mix_slot", T.LongType())])


def _slots(blocks: dict, weights: dict):
    """One task's work: the schedule as rows, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(batch.num_rows for batch in batches):
            return
        rows, first = [], 0
        for s, block, phase in schedule(blocks, weights):
            rows.append(("n" if s is None else f"v{s}", block, phase, first + len(rows)))
            if len(rows) == 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_SLOTS.names)
                first, rows = first + len(rows), []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_SLOTS.names)

    return run


_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64()]


def mix(df: DataFrame, source: str, key: str, weights: dict | None = None, *, block_rows: int = BLOCK_ROWS,
        temperature: float = TEMPERATURE) -> DataFrame:
    """``df`` with ``mix_block`` (the row's block inside its source), ``mix_phase``,
    ``mix_slot`` (the block's place in the whole mixture) and ``mix_place`` (the row's place
    in the block). Sorted by slot and place, rows are mixed to the weights.

    Every row is kept once. Inside a source, rows come in the order of their key's hash, then of all columns, which must be
    orderable. Columns with one of the four names are replaced; other names are free. A null source is a source of its own (weights key None). Sources without a given weight are an error.
    Weights are positive. An empty table gives an empty table. Only the row count per source
    comes to the driver.
    """
    spark = df.sparkSession
    df = df.drop("mix_block", "mix_phase", "mix_slot", "mix_place")
    counts = {r[0]: r[1] for r in df.groupBy(source).agg(F.count(F.lit(1))).collect()}
    if weights is None:
        weights = {s: float(n) ** temperature for s, n in counts.items()}
    if missing := [s for s in counts if weights.get(s, 0) <= 0]:
        raise ValueError(f"no positive weight for sources {missing[:5]}")
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    table = stored(spark.range(0, 1, 1, 1).mapInArrow(_slots(blocks, {s: weights[s] for s in counts}), _SLOTS), "slots")
    rows = df.select(F.struct("*").alias("_row"), F.xxhash64(F.col(key)).alias("_h"), F.col(source).alias("_g"), F.lit(1).cast("long").alias("_c"))
    named = ranked(rows).withColumn("_s", F.coalesce(F.concat(F.lit("v"), F.col(f"_row.{source}").cast("string")), F.lit("n")))
    placed = named.withColumn("mix_block", F.expr(f"_rank div {block_rows}")).join(table, ["_s", "mix_block"])
    return placed.select("_row.*", "mix_block", "mix_phase", "mix_slot", (F.col("_rank") % block_rows).cast("int").alias("mix_place"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mixture of the sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs, "source", "doc_id")
