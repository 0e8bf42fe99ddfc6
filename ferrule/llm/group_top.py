"""Problem 5: the N best items of every group, by secondary sort and streaming."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.tables import table


def _starts(batch: pa.RecordBatch, groups: list[str]) -> list[int]:
    """Row numbers at which another group begins (nulls are equal to each other)."""
    n, new = batch.num_rows, None
    for g in groups:
        a, b = batch[g].slice(1), batch[g].slice(0, n - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new = other if new is None else pc.or_(new, other)
    return [0] + [i + 1 for i in pc.indices_nonzero(new).to_pylist()] + [n]


def _stream(batches, groups: list[str], item: str, n: int):
    """Of rows sorted by groups, falling score and item: the first n distinct items of each group, with their rank.

    Between batches only the current group and its at most n items are held.
    """
    current, seen = None, set()
    for batch in batches:
        if not batch.num_rows:
            continue
        items, at = batch[item], _starts(batch, groups)
        take, ranks = [], []
        for start, end in zip(at, at[1:]):
            if start == 0:
                key = tuple(batch[g][0].as_py() for g in groups)
                if key != current:
                    seen = set()
            else:
                seen = set()
            for i in range(start, end):
                if len(seen) == n:
                    break
                value = items[i].as_py()
                if value not in seen:
                    seen.add(value)
                    take.append(i)
                    ranks.append(len(seen))
        current = tuple(batch[g][batch.num_rows - 1].as_py() for g in groups)
        if take:
            kept = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ranks, pa.int32())], names=[*kept.schema.names, "position"])


def top_per_group(rows: DataFrame, groups: list[str], score: str, item: str, n: int) -> DataFrame:
    """(groups, item, score, position): the ``n`` best distinct items of every group, best score first, ties by the smaller item.

    Rows with a null item, or a null or NaN score, do not count; an item that occurs again counts with its best score; a null
    group key is a group of its own. Every task first sorts its own rows and streams off the n best of each group: an
    item of the overall best n is among the n best wherever its best row lies, so nothing is lost, and a group of
    any size sends at most n rows per task to the hash partition where the same sort and stream give the result.
    Other columns of ``rows`` are not read. An empty table gives no rows.
    """
    schema = rows.select(*groups, item, F.col(score).cast("double").alias(score)).schema.add("position", T.IntegerType())
    usable = rows.select(*groups, item, F.col(score).cast("double").alias(score)).where(F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    order = [*groups, F.col(score).desc(), item]
    stream = lambda it: _stream(it, groups, item, n)
    local = usable.sortWithinPartitions(*order).mapInArrow(stream, schema).drop("position")
    return local.repartition(*groups).sortWithinPartitions(*order).mapInArrow(stream, schema)


def usable_results(runs: DataFrame) -> DataFrame:
    """Rows of runs with doc_id as a number; a doc_id that is no whole number becomes null."""
    return runs.where("topic IS NOT NULL AND doc_id IS NOT NULL").select("topic", "run_name", F.expr("try_cast(trim(doc_id) AS bigint)").alias("doc_id"), "score")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(usable_results(table(spark, sf_dir, "runs")), ["topic", "run_name"], "score", "doc_id", 5).select("topic", "run_name", "doc_id")


def p5_leading_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(usable_results(table(spark, sf_dir, "runs")), ["topic", "run_name"], "score", "doc_id", 20)


_TOP_SQL = """
SELECT topic, run_name, doc_id, score, CAST(row_number() OVER (PARTITION BY topic, run_name ORDER BY score DESC, doc_id) AS INTEGER) AS position
FROM (SELECT topic, run_name, try_cast(trim(doc_id) AS BIGINT) AS doc_id, max(score) AS score FROM runs
      WHERE topic IS NOT NULL AND try_cast(trim(doc_id) AS BIGINT) IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"""

QUERIES = {"p5_found": p5_found, "p5_leading_results": p5_leading_results}
ORACLES = {
    "p5_found": f"SELECT topic, run_name, doc_id FROM ({_TOP_SQL}) WHERE position <= 5",
    "p5_leading_results": f"SELECT * FROM ({_TOP_SQL}) WHERE position <= 20",
}
