"""Problem 7: filling containers of fixed capacity with texts, by bulk-synchronous best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.token_sizes import TOKENIZER, token_sizes, tokenizer_of
from ferrule.tables import durable, table

#: Items of one size that a task numbers: a size has as many lanes, numbered independently of each other, as its items need.
LANE_ITEMS = 200_000

PLAN = T.StructType([
    T.StructField("pack_id", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("low", T.LongType()),
    T.StructField("high", T.LongType()), T.StructField("container", T.LongType()), T.StructField("each", T.LongType()), T.StructField("room", T.LongType()),
])


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (size, low, high, container, each, room): the items of a size with ranks low..high-1 go to consecutive containers, ``each`` to one.

    Items and gaps are held as the runs of their sorted order: all items of one size, and ranges of containers with one
    gap. A superstep takes the largest size not placed, sweeps the gaps for its successor (the smallest gap that it
    fits), gives the k-th item of the run to the k-th place of that gap's containers, and updates the gaps; it repeats with the next
    successor until the run is placed, opening containers where no gap fits. Because equal items and equal gaps are
    exchangeable, this does at once what single matches of equal runs would do in turn. Its input and its work are
    bounded by the capacity, not by the number of items. ``room`` is the gap before.
    """
    plan: list = []
    gaps: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first container, containers)
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not ranges[gap]:
                insort(gaps, gap)
            ranges[gap].append((first, n))

    for size in sorted((s for s in counts if 0 < s <= capacity), reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                each = capacity // size
                n = -(-left // each)
                put(capacity, opened, n)
                opened += n
                continue
            gap = gaps[at]
            first, n = ranges[gap].pop()
            if not ranges[gap]:
                gaps.pop(at)
            each = gap // size
            filled = min(n, left // each)
            if filled:
                plan.append((size, rank, rank + filled * each, first, each, gap))
                put(gap - each * size, first, filled)
                left, rank, first, n = left - filled * each, rank + filled * each, first + filled, n - filled
            if n and left:  # fewer than fill one container
                plan.append((size, rank, rank + left, first, left, gap))
                put(gap - left * size, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(gap, first, n)
    return plan


def pieces(sized: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """(pack_id, capacity, key, piece, start, size): each text whole, or cut into full pieces and a rest where it exceeds the capacity."""
    fitted = sized.crossJoin(F.broadcast(limits.select("pack_id", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()))  # the table of limits is fixed
    cut = F.when(F.col("n_tokens") <= F.col("capacity"), F.lit(1)).otherwise(F.ceil(F.col("n_tokens") / F.col("capacity")))
    parts = fitted.withColumn("piece", F.explode(F.sequence(F.lit(0), (cut - 1).cast("int"))))
    start = F.col("piece") * F.col("capacity")
    return parts.select("pack_id", "capacity", key, "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.col("capacity")).alias("size"))


def packed(documents: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, lane_items: int = LANE_ITEMS) -> DataFrame:
    """(pack_id, container_id, key, piece, start, n_tokens): every text in one container per capacity; longer ones in pieces of full capacity and a rest.

    The tokens are counted once and the sizes written to the checkpoint folder. Items are sorted into runs of equal size, ordered within a
    run by a hash lane and key, and so ranked without a single task ever holding a run: a run has a lane for every ``lane_items`` items, and the counts of the
    lanes before give each lane its first rank. ``best_fit_plan`` works on the counts of the runs. Each item then finds its
    container by joining its size and rank with the plan, whose size the capacities bound. A text of 0 tokens (null or
    empty) is kept with a null container: it needs none. Rows repeated in the table are packed as often as they occur. A
    limit that is null or below 1 is ignored.
    """
    spark = documents.sparkSession
    bounds = limits.where("capacity_tokens >= 1 AND pack_id IS NOT NULL")
    sized = durable(token_sizes(documents, [key], text, tokenizer))
    parts = pieces(sized, bounds, key)
    empty = parts.where("size = 0").select("pack_id", F.lit(None).cast("long").alias("container_id"), key, "piece", "start", F.col("size").alias("n_tokens"))
    items = parts.where("size > 0")
    counts: dict = defaultdict(dict)
    for row in items.groupBy("pack_id", "capacity", "size").agg(F.count(F.lit(1)).alias("n")).collect():  # at most the capacity's number of rows for each limit
        counts[row.pack_id, row.capacity][row["size"]] = row.n
    plan = [(pack, *step) for (pack, capacity), run in counts.items() for step in best_fit_plan(run, capacity)]
    lanes = spark.createDataFrame([(pack, size, -(-n // lane_items)) for (pack, _), run in counts.items() for size, n in run.items()], "pack_id int, size long, lanes int")
    laned = items.join(F.broadcast(lanes), ["pack_id", "size"]).withColumn("lane", F.pmod(F.xxhash64(key, "piece"), F.col("lanes")).cast("int"))  # as many rows as counted
    before = Window.partitionBy("pack_id", "size").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laned.where("lanes > 1").groupBy("pack_id", "size", "lane").agg(F.count(F.lit(1)).alias("n")).select("pack_id", "size", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("pack_id", "size", "lane").orderBy(key, "piece")
    ranked = laned.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["pack_id", "size", "lane"], "left").withColumn("rank", F.col("rank") + F.coalesce("offset", F.lit(0)))
    placed = ranked.join(F.broadcast(spark.createDataFrame(plan, PLAN)), ["pack_id", "size"]).where("rank >= low AND rank < high")
    container = F.col("container") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))
    return placed.select("pack_id", container.cast("long").alias("container_id"), key, "piece", "start", F.col("size").alias("n_tokens")).unionByName(empty)


def fill_report(packing: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_id, capacity, containers, tokens, least_containers, fill): how full the containers are; least is tokens / capacity rounded up."""
    held = packing.where("container_id IS NOT NULL").groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("pack_id")
    sums = held.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return sums.join(F.broadcast(limits), "pack_id").select(
        "pack_id", F.col("capacity_tokens").alias("capacity"), "containers", "tokens", "fullest",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"),
    )


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"), tokenizer=tokenizer_of(spark))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "pack_limits")
    return fill_report(packed(table(spark, sf_dir, "documents"), limits, tokenizer=tokenizer_of(spark)), limits)


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
ORACLES: dict[str, str] = {}
