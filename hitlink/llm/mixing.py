"""Operator 5: mixing sources to target weights by Pfair scheduling.

A source is a queue of blocks. With weight w, block j is released at slot floor(j / w) and due by slot
ceil((j + 1) / w). Each slot takes the released block with the earliest deadline. As the weights sum to 1, no block
misses its deadline, so after any number of slots t each source has had w * t blocks, give or take less than one.

Weights are rounded to whole numbers of 2^36 parts (at least one each), so rounding comes to less than a block in 10^10
slots. Blocks are dealt one after another by a heap over the sources, whose state (the blocks that each source has had)
is noted at the begin of every ``cycle`` slots; the slots of a cycle follow from it.

Once a source has no block left its slots are passed over and the others go on in their order, so no row is lost;
``balanced`` is true for the slots up to the first one that had to be passed over.

At scale: rows of a source are put in order by hash and numbered in ranges of that hash, one task each with about
``RANGE_ROWS`` rows, however large the source. The driver goes through the blocks once, two heap steps for each (a block
being ``block`` rows), and keeps the states alone; tasks deal the cycles again from them. That gives a row for each block,
broadcast up to ``BROADCAST_ENTRIES`` rows and joined by source and block beyond.

Null sources are one source of their own. Sources without a weight, or with one that is not positive, have no slot (null)
and come last. Repeated rows are rows of their own, in an order that their other columns do not change.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CYCLE = 1000                    # slots between noted states
PARTS = 2**36                   # that weights are rounded to
BLOCK = 16
RANGE_ROWS = 10_000
BROADCAST_ENTRIES = 500_000     # slots


def shares(weights: Mapping[str, float], cycle: int) -> dict[str, int]:
    """Blocks of each source in a cycle: at least one, otherwise by largest remainders, ``cycle`` in all."""
    weights = {k: w for k, w in weights.items() if w > 0}
    total = math.fsum(weights.values())
    exact = {k: w / total * cycle for k, w in weights.items()}
    blocks = {k: max(1, math.floor(x)) for k, x in exact.items()}
    spare = cycle - sum(blocks.values())
    order = sorted(exact, key=lambda k: (blocks[k] - exact[k], k))
    for k in order[: max(spare, 0)]:
        blocks[k] += 1
    while spare < 0:
        k = max(blocks, key=lambda k: (blocks[k], k))
        cut = min(blocks[k] - 1, -spare)
        blocks[k] -= cut
        spare += cut
    return blocks


def deal(parts: Mapping[str, int], have: Mapping[str, int], done: dict[str, int], start: int) -> Iterator[tuple[int, str, int]]:
    """(slot, source, block) from slot ``start`` on, earliest deadline first among released blocks. ``done`` holds the blocks
    dealt before and is kept up to date. A source's slot after its last block comes as block ``have``, and no other of it."""
    total = sum(parts.values())
    waiting = [(done[k] * total // parts[k], k) for k in parts if done[k] <= have[k]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    t = start
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-((done[k] + 1) * -total // parts[k]), k))
        due, k = heapq.heappop(ready)
        assert t < due
        yield t, k, done[k]
        done[k] += 1
        if done[k] <= have[k]:
            heapq.heappush(waiting, (done[k] * total // parts[k], k))
        t += 1


def schedule(blocks: Mapping[str, int]) -> list[str]:
    """The source of each slot when the sources have these numbers of blocks, and weights like them."""
    return [k for _, k, _ in itertools.islice(deal(blocks, blocks, dict.fromkeys(blocks, 0), 0), sum(blocks.values()))]


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def temperature_weights(df: DataFrame, source_col: str = "source", temperature: float = 0.5) -> dict[str | None, float]:
    """Rows of each source to the power ``temperature``; one row per source comes to the driver."""
    return {r[0]: r[1] ** temperature for r in df.groupBy(source_col).agg(F.count("*").alias("__n")).collect()}


def mix(df: DataFrame, weights: Mapping[str | None, float], id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK,
        cycle: int = CYCLE, seed: int = 7) -> DataFrame:
    """``df`` with ``slot`` (long), ``place`` (long, in the block) and ``balanced``: (slot, place) is the mixed order. Columns of
    these names in ``df`` are replaced."""
    spark = df.sparkSession
    df = df.drop("slot", "place", "balanced")
    plan = shares({"-" if k is None else f"={k}": w for k, w in weights.items()}, PARTS)
    per_source = df.groupBy(_key(F.col(source_col)).alias("__source")).agg(F.count("*").alias("n")).collect()
    blocks = {r["__source"]: -(-r.n // block) for r in per_source}
    have = {k: blocks.get(k, 0) for k in plan}
    # The state at every cycle's begin, from which tasks deal the cycles again, and the first slot that its source cannot fill.
    done, states, horizon = dict.fromkeys(plan, 0), [], None
    for number, (t, k, turn) in enumerate(deal(plan, have, done, 0)):
        if number % cycle == 0:
            states.append((t, [done[x] for x in plan]))
        if horizon is None and turn == have[k]:
            horizon = t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                dealt = itertools.islice(deal(plan, have, dict(zip(plan, at)), start), cycle)
                slots, sources, turns = zip(*dealt)
                yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(turns, pa.int64()), pa.array(slots, pa.int64())],
                                                 names=["__source", "__block", "slot"])

    spots = spark.createDataFrame(states, "start long, done array<long>").mapInArrow(run, "__source string, __block long, slot long")
    if sum(have.values()) <= BROADCAST_ENTRIES:
        spots = F.broadcast(spots)

    draw = F.xxhash64(F.lit(seed), F.col(id_col))
    ranges = max(1, df.count() // RANGE_ROWS)
    inner = Window.partitionBy("__source", "__range").orderBy("__draw", id_col)
    data = (df.withColumn("__source", _key(F.col(source_col))).withColumn("__draw", draw)
            # ranges of the hash in its own order: the draw's distance from the smallest long, cut into equal parts
            .withColumn("__range", F.floor((F.col("__draw").cast("double") / 2.0**64 + 0.5) * ranges)))
    counts = data.groupBy("__source", "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__source").orderBy("__range")) - F.col("__n")
    counts = counts.select("__source", "__range", before.alias("__before"))
    numbered = (data.withColumn("__number", F.row_number().over(inner) - 1).join(counts, ["__source", "__range"])
                .withColumn("__number", F.col("__number") + F.col("__before"))
                .withColumn("__block", F.floor(F.col("__number") / block)))
    slotted = numbered.join(spots, ["__source", "__block"], "left")
    return slotted.select(*[F.col(f"`{c}`") for c in df.columns], F.col("slot").cast("long").alias("slot"),
                          (F.col("__number") % block).cast("long").alias("place"),
                          F.coalesce(F.col("slot") < (horizon or 0), F.lit(False)).alias("balanced"))


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix`` in files that follow the mixed order, rows without a slot last."""
    order = [F.col("slot").asc_nulls_last(), F.col("place")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs, temperature_weights(docs))
