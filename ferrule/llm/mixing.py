"""Problem 8: mixing sources to target shares of the total size, by a low-discrepancy schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.token_sizes import TOKENIZER, token_sizes, tokenizer_of
from ferrule.tables import durable, table

#: Texts of one source, and slots, that a task numbers.
LANE_TEXTS, STRETCH = 200_000, 65_536
#: Turns by which a source can be behind its share of the slots.
SPARE = 32
GOLDEN = (math.sqrt(5) - 1) / 2


def _source(column: str) -> Column:
    return F.lower(F.trim(column))


def targets_of(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, max_repeats) of the table of targets, shares scaled to 1; a null share or one of 0 asks for nothing, null repeats mean 1."""
    rows = targets.groupBy(_source("source").alias("s")).agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).where("s IS NOT NULL AND w > 0").orderBy("s").collect()
    total = sum(r.w for r in rows)
    return [(r.s, r.w / total, max(1, r.r if r.r is not None else 1)) for r in rows]


def shuffled_texts(documents: DataFrame, sources: list[str], seed: int, tokenizer: str, lane_texts: int = LANE_TEXTS) -> DataFrame:
    """(source, start, doc_id, n_tokens): each source's distinct texts in a hashed order, with the tokens of the source before them.

    Of equal texts the one with the smallest doc_id stays, so
    that no text can be used more often under another id; a source loses a text that another has under a smaller id. The order is by hash lane and hash; a source has
    a lane for every ``lane_texts`` texts, and the lanes' token sums give each lane its first position, so that no task holds a source. The result is written to the checkpoint folder.
    """
    wanted = documents.select("doc_id", _source("source").alias("source"), "text").where(F.col("source").isin(sources) & F.col("doc_id").isNotNull() & (F.col("text") != ""))
    sized = token_sizes(wanted.withColumn("print", F.sha2("text", 256)), ["doc_id", "source", "print"], "text", tokenizer)
    once = durable(sized.groupBy("print").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("kept")).select("kept.*").where("n_tokens > 0"))
    lanes = once.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / lane_texts).alias("lanes"))
    hashed = once.join(F.broadcast(lanes), "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("lane", F.pmod("h", F.col("lanes")).cast("int"))  # one row a source of the targets
    sums = hashed.groupBy("source", "lane").agg(F.sum("n_tokens").alias("t"))
    starts = sums.select("source", "lane", (F.sum("t").over(Window.partitionBy("source").orderBy("lane")) - F.col("t")).alias("start"))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "lane").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    position = hashed.withColumn("end", within).join(starts, ["source", "lane"])
    return position.select("source", (F.col("start") + F.col("end") - F.col("n_tokens")).alias("start"), "doc_id", "n_tokens")


def schedule(spark: SparkSession, slots: int, shares: list[tuple[str, float]], stretch: int = STRETCH) -> DataFrame:
    """(slot, source, turn): slot i falls to the source whose share of [0, 1) holds the fractional part of i times the golden ratio.

    Any run of slots thus holds each source close to its share. ``turn`` numbers a source's slots from 0; stretches of slots
    are numbered by different tasks and start after the source's count in the stretches before.
    """
    edge, source = 0.0, None
    point = F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0))
    for name, share in shares[:-1]:
        edge += share
        source = (source.when if source is not None else F.when)(point < edge, name)
    source = source.otherwise(shares[-1][0]) if source is not None else F.lit(shares[-1][0])
    drawn = spark.range(slots).withColumnRenamed("id", "slot").select("slot", source.alias("source"), F.floor(F.col("slot") / stretch).alias("stretch"))
    counts = drawn.groupBy("source", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("source", "stretch", (F.sum("n").over(Window.partitionBy("source").orderBy("stretch")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
    return drawn.withColumn("turn", local).join(before, ["source", "stretch"]).select("slot", "source", (F.col("turn") + F.col("before")).alias("turn"))


def mixed(documents: DataFrame, targets: DataFrame, block: int = 256, seed: int = 11, tokenizer: str = TOKENIZER) -> DataFrame:
    """(slot, source, doc_id, pass_no, n_tokens): the largest selection in which every source keeps its share and no text exceeds max_repeats.

    Sources and targets are matched trimmed and lower-cased. A source may fill its repeats x its tokens; the smallest
    repeats x tokens / share of any source is the total size, and of this size every source gets its share in tokens. A source without any text is left out
    and the shares of the others grow in proportion; the report shows it with 0. Texts are drawn in the source's hashed order, again from the first when
    all are used: pass_no counts from 1. The draw across the end of a source's part is kept if at least half of it lies within, so a source
    misses its part by half a text at most. A draw stands in the slot in which its first token falls when each slot of the source takes ``block`` tokens. Rows
    without doc_id or with an empty text cannot be drawn.
    """
    spark = documents.sparkSession
    wanted = targets_of(targets)
    schema = "slot long, source string, doc_id long, pass_no long, n_tokens long"
    texts = shuffled_texts(documents, [s for s, _, _ in wanted], seed, tokenizer)
    held = {r.source: r.tokens for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
    usable = [(s, w, held[s], n) for s, w, n in wanted if s in held]
    if not usable:
        return spark.createDataFrame([], schema)
    total = sum(w for _, w, _, _ in usable)
    size = min(t * n / (w / total) for _, w, t, n in usable)
    parts = [(s, t, size * w / total, min(n, math.ceil(size * w / total / t))) for s, w, t, n in usable]
    fixed = spark.createDataFrame(parts, "source string, tokens long, part double, passes long")
    begin = (F.col("pass_no") - 1) * F.col("tokens") + F.col("start")
    passes = texts.join(F.broadcast(fixed), "source").withColumn("pass_no", F.explode(F.sequence(F.lit(1).cast("long"), "passes")))  # one row a source of the targets
    drawn = passes.where(begin + F.col("n_tokens") / 2 <= F.col("part")).withColumn("turn", F.floor(begin / block))
    longest = math.ceil(size / block) + math.ceil(SPARE / min(w / total for _, w, _, _ in usable))
    turns = schedule(spark, longest, [(s, w / total) for s, w, _, _ in usable])
    return drawn.join(turns, ["source", "turn"], "left").select(F.coalesce("slot", F.lit(longest)).alias("slot"), "source", "doc_id", "pass_no", "n_tokens")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, texts, draws, most_repeats, max_repeats) for every source of the targets."""
    per_text = selection.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t"))
    got = per_text.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("texts"), F.sum("k").alias("draws"), F.max("k").alias("most_repeats"))
    total = got.agg(F.sum("tokens").alias("total"))
    asked = targets.select(_source("source").alias("source"), "target_share", "max_repeats")
    joined = asked.join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"), zero("tokens"), zero("texts"), zero("draws"), zero("most_repeats"), "max_repeats")


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tokenizer=tokenizer_of(spark))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return shares(mixed(table(spark, sf_dir, "documents"), targets, tokenizer=tokenizer_of(spark)), targets)


QUERIES = {"p8_selection": p8_selection, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
