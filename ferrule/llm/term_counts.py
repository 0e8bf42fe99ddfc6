"""Problem 1: occurrences and records of every distinct term, by burst tries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.tables import table, written

BURST = 256
#: A task's trie sends its entries on and starts anew beyond so many terms: its memory does not grow with the vocabulary.
HELD_TERMS = 500_000
#: Routing prefixes are no longer than this; a prefix is cut further while it has more entries than a partition's share over SPREAD.
LONGEST, SPREAD = 24, 4
#: Entries of a partition that are aimed at.
PARTITION_ENTRIES = 2_000_000


class BurstTrie:
    """Term -> (occurrences, records) in containers that burst into a trie level when they outgrow ``burst`` terms.

    An inner node is a dict from the next character to a child, with the empty string for a term that ends there; a
    container is a ``_Bucket``, a dict from the rest of the term to its two counters. The prefix that leads to a
    container is therefore as long as the vocabulary under it is dense.
    """

    class _Bucket(dict):
        pass

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: dict = self._Bucket()

    def add(self, term: str, occurrences: float, records: int) -> bool:
        """Whether the term is new."""
        node, parent, at = self.root, None, 0
        while type(node) is dict:
            step = term[at : at + 1]
            parent, child = node, node.get(step)
            if child is None:
                child = node[step] = self._Bucket()
            node, at = child, at + len(step)
        rest = term[at:]
        held = node.get(rest)
        if held is not None:
            held[0] += occurrences
            held[1] += records
            return False
        node[rest] = [occurrences, records]
        if len(node) > self.burst and (parent is None or step):
            split: dict = {}
            for suffix, counters in node.items():
                split.setdefault(suffix[:1], self._Bucket())[suffix[1:]] = counters
            if parent is None:
                self.root = split
            else:
                parent[step] = split
        return True

    def items(self) -> Iterator[tuple[str, float, int]]:
        """All terms in order of their prefixes, without recursion (terms may be very long)."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is dict:
                stack.extend((prefix + step, node[step]) for step in sorted(node, reverse=True))
            else:
                for suffix in sorted(node):
                    yield prefix + suffix, *node[suffix]


_ENTRY = "term string, occurrences double, records long"


def _entries(terms: list, occurrences: list, records: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(occurrences, pa.float64()), pa.array(records, pa.int64())], names=["term", "occurrences", "records"])


def _drained(trie: BurstTrie):
    out: tuple[list, list, list] = ([], [], [])
    for entry in trie.items():
        for column, value in zip(out, entry):
            column.append(value)
        if len(out[0]) == 20_000:
            yield _entries(*out)
            out = ([], [], [])
    yield _entries(*out)


def _count(batches, burst: int, held_terms: int):
    """The entries of one task's trie; a trie of too many terms is sent on and a new one begun."""
    trie, held = BurstTrie(burst), 0
    for batch in batches:
        done = pa.Table.from_batches([batch]).group_by("term").aggregate([("occurrences", "sum"), ("term", "count")])
        for term, occurrences, records in zip(done["term"].to_pylist(), done["occurrences_sum"].to_pylist(), done["term_count"].to_pylist()):
            held += trie.add(term, occurrences, records)
        if held > held_terms:
            yield from _drained(trie)
            trie, held = BurstTrie(burst), 0
    yield from _drained(trie)


def routing_prefixes(entries: DataFrame, parts: int) -> frozenset[str]:
    """The prefixes with more entries than a partition's share over ``SPREAD``: terms under them are told apart by a longer prefix.

    They are at most ``LONGEST`` x ``SPREAD`` for each partition.
    """
    most = max(1, entries.count() // (SPREAD * parts))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(LONGEST))), lambda i: F.substring("term", F.lit(1), i))
    heavy = entries.select(F.explode(prefixes).alias("prefix")).groupBy("prefix").count().where(F.col("count") > most)
    return frozenset(r.prefix for r in heavy.collect())


def _routed(batches, heavy: frozenset[str]):
    """Entries with the shortest prefix of the term that is not heavy: the subtree it belongs to. A heavy one of full length stays whole, a heavy term is its own."""
    for batch in batches:
        prefixes = []
        for term in batch["term"].to_pylist():
            n = 1
            while term[:n] in heavy and n < min(len(term), LONGEST):
                n += 1
            prefixes.append(term[:n])
        yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), *batch.columns], names=["prefix", *batch.schema.names])


def _merged(batches):
    """Subtrees of all workers merged: of entries in order of term, equal terms added up. Only the last term is held between batches."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch["term"]
        starts = np.append(0, np.nonzero(pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False))[0] + 1)
        names = terms.take(pa.array(starts)).to_pylist()
        occurrences, records = (np.add.reduceat(batch[c].to_numpy(zero_copy_only=False), starts).tolist() for c in ("occurrences", "records"))
        if last is not None:
            if last[0] == names[0]:
                occurrences[0], records[0] = occurrences[0] + last[1], records[0] + last[2]
            else:
                names, occurrences, records = [last[0], *names], [last[1], *occurrences], [last[2], *records]
        last = (names.pop(), occurrences.pop(), records.pop())
        yield _entries(names, occurrences, records)
    if last is not None:
        yield _entries([last[0]], [last[1]], [last[2]])


def latest_term_rows(vectors: DataFrame) -> DataFrame:
    """(pmid, term, occurrences): per (pmid, field, term) the row with the latest loaded_at, summed over fields.

    Terms are trimmed and lower-cased. Rows with null pmid, or null or blank term, are no rows. Of rows with equal
    loaded_at the larger term_frequency counts; a null loaded_at is the oldest; a null term_frequency counts 0 times.
    """
    rows = vectors.select("pmid", "field", F.lower(F.trim("term")).alias("term"), "loaded_at", "term_frequency").where("pmid IS NOT NULL AND term <> ''")
    held = rows.groupBy("pmid", "field", "term").agg(F.max(F.struct("loaded_at", "term_frequency")).alias("last"))
    return held.groupBy("pmid", "term").agg(F.coalesce(F.sum("last.term_frequency"), F.lit(0.0)).alias("occurrences"))


def term_counts(vectors: DataFrame, burst: int = BURST, held_terms: int = HELD_TERMS, entries_a_part: int = PARTITION_ENTRIES) -> DataFrame:
    """(term, occurrences, records) of every distinct term of term-vector rows.

    Each worker counts its rows in a burst trie and sends on its entries. The prefixes that route them adapt to the entries: a prefix is cut
    one character further where the vocabulary under it is dense, so that each is a subtree of bounded share. All workers' parts of a subtree meet in one
    task, in order of term, and are merged in the stream. An empty table gives no rows; extra columns are ignored.
    """
    entries = written(latest_term_rows(vectors).select("term", "occurrences").mapInArrow(lambda it: _count(it, burst, held_terms), _ENTRY))
    spark = vectors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries.count() / entries_a_part))
    heavy = routing_prefixes(entries, parts)
    routed = entries.mapInArrow(lambda it: _routed(it, heavy), f"prefix string, {_ENTRY}").repartition(parts, "prefix").sortWithinPartitions("term")
    return routed.drop("prefix").mapInArrow(_merged, _ENTRY)


def marked_terms(vectors: DataFrame, min_records: int = 3, min_occurrences: float = 5.0, max_share: float = 0.52) -> DataFrame:
    """``term_counts`` with mark: ``rare`` below either minimum, else ``common`` above ``max_share`` of all records, else ``kept``."""
    total = vectors.agg(F.count_distinct("pmid").alias("all_records"))
    counted = term_counts(vectors).crossJoin(F.broadcast(total))  # one row
    mark = (
        F.when((F.col("records") < min_records) | (F.col("occurrences") < min_occurrences), "rare")
        .when(F.col("records") > max_share * F.col("all_records"), "common")
        .otherwise("kept")
    )
    return counted.select("term", "occurrences", "records", mark.alias("mark"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(table(spark, sf_dir, "term_vectors")).where("mark <> 'kept'").select("term", "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(table(spark, sf_dir, "term_vectors"))


_TERMS_SQL = """
WITH rows_ AS (
  SELECT pmid, field, lower(trim(term)) AS term, term_frequency,
         row_number() OVER (PARTITION BY pmid, field, lower(trim(term)) ORDER BY loaded_at DESC NULLS LAST, term_frequency DESC NULLS LAST) AS r
  FROM term_vectors WHERE pmid IS NOT NULL AND trim(term) <> ''),
counted AS (
  SELECT term, coalesce(sum(term_frequency), 0.0) AS occurrences, count(DISTINCT pmid) AS records FROM rows_ WHERE r = 1 GROUP BY term)
SELECT term, occurrences, records,
       CASE WHEN records < 3 OR occurrences < 5 THEN 'rare'
            WHEN records > 0.52 * (SELECT count(DISTINCT pmid) FROM term_vectors) THEN 'common' ELSE 'kept' END AS mark
FROM counted"""

QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms}
ORACLES = {"p1_found": f"SELECT term, mark FROM ({_TERMS_SQL}) WHERE mark <> 'kept'", "p1_terms": _TERMS_SQL}
