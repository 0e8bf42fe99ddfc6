"""Problem 4: records that are the same text apart from small changes, by deletion-variant signatures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.records import TERMS_SQL, current_records, record_terms
from ferrule.tables import durable, table, written

#: Term ranks below this spread the commonest terms evenly over the segments; it bounds what a task is sent.
RANKED_TERMS = 2048
#: Numbers of segments in use are multiples of this.
STEP = 6
SKETCH_WORDS = 3
#: A bucket of more rows than this is matched by signature in a second round, and a signature of more whole segments there in tiles.
HOT = 50_000
#: Pairs are formed in chunks of at most this many.
CHUNK = 131_072
#: A signature with at least this many matches is tested as a block of its own.
BLOCK_PAIRS = 2_000
#: Rows of a shuffle partition that are aimed at.
PARTITION_ROWS = 1_500_000
#: Words of 32 bits before the codes of a routed row: id, size, sketch.
HEAD = 3 + 2 * SKETCH_WORDS
#: Set in the size word of a row that stands for a segment without its rarest term.
WITHOUT = np.uint32(1 << 31)
_FOUND = "a long, b long, size int, " + ", ".join(f"w{w} long" for w in range(SKETCH_WORDS))


def difference_bound(size_a, size_b, threshold: float):
    """The most terms in which two sets of these sizes can differ at this Jaccard similarity."""
    return np.floor((1 - threshold) / (1 + threshold) * (np.asarray(size_a) + size_b) + 1e-9).astype(np.int64)


def segments_for(bound):
    """Segments so that sets differing in ``bound`` terms have a segment that differs in at most one: half as many as terms, up to the step."""
    return -(-(bound // 2 + 1) // STEP) * STEP


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping multiplications and shifts)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _rows(bucket: np.ndarray, head: np.ndarray, n: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
    """(bucket, row): each row the words of ``head`` and then ``n`` words of ``tail``."""
    start = np.cumsum(HEAD + n) - (HEAD + n)
    data = np.empty(int((HEAD + n).sum()), np.uint32)
    data[start[:, None] + np.arange(HEAD)] = head
    data[np.repeat(start + HEAD - (np.cumsum(n) - n), n) + np.arange(len(tail))] = tail
    offsets = np.append(start, len(data)).astype(np.int32) * 4
    rows = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), rows], names=["bucket", "row"])


def _routed(batches, ranked: np.ndarray, threshold: float):
    """Rows (bucket, row) for batches of (id, size, hashes): every segment of a set, sent to where it and its one-deletion variants can meet others.

    ``ranked`` are the hashes of the commonest terms, commonest first. The segment of a ranked term follows its rank
    to and fro over the segments; that of any other term its hash. A set is cut for every number of segments that
    its pairing with a set of an admissible size can need. A segment and its variants without one term all hold the
    segment's rarest term, except the variant without just that: so the segment goes to the bucket of its rarest term with the codes of
    its terms, rarest first, and the sum of the others' codes to the bucket of its second rarest. Segments and variants without any
    term have a bucket of their own.
    """
    by_hash = np.argsort(ranked)
    sorted_ranked = ranked[by_hash]
    for batch in batches:
        ids = np.ascontiguousarray(batch["id"].to_numpy(zero_copy_only=False))
        sizes = batch["size"].to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = pa.array(batch["hashes"]).flatten().to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        doc = np.repeat(np.arange(len(ids)), sizes)
        at = np.minimum(np.searchsorted(sorted_ranked, hashes), max(len(ranked) - 1, 0))
        known = sorted_ranked[at] == hashes if len(ranked) else np.zeros(len(hashes), bool)
        rank = by_hash[at] if len(ranked) else np.zeros(len(hashes), np.int64)
        code = _mix(hashes.view(np.uint64))
        common = np.where(known, (1 << 45) - rank, (code >> np.uint64(20)).astype(np.int64))  # the smaller, the rarer
        sketch = np.zeros((len(ids), SKETCH_WORDS), np.uint64)
        bit = (code >> np.uint64(40)) % np.uint64(64 * SKETCH_WORDS)
        np.bitwise_xor.at(sketch, (doc, (bit // np.uint64(64)).astype(np.int64)), np.uint64(1) << (bit % np.uint64(64)))
        head = np.empty((len(ids), HEAD), np.uint32)
        head[:, :2], head[:, 2], head[:, 3:] = ids.view(np.uint32).reshape(-1, 2), sizes, sketch.view(np.uint32)
        least = segments_for(difference_bound(sizes, np.ceil(sizes * threshold - 1e-9).astype(np.int64), threshold))
        most = segments_for(difference_bound(sizes, np.floor(sizes / threshold + 1e-9).astype(np.int64), threshold))
        for m in range(int(least.min()), int(most.max()) + 1, STEP):
            signs = (least <= m) & (m <= most)
            if not signs.any():
                continue
            own = signs[doc]
            d, c, r, k, rare = doc[own], code[own], rank[own], known[own], common[own]
            lap, place = r // m, r % m
            segment = np.where(k, np.where(lap % 2 == 0, place, m - 1 - place), (c % np.uint64(m)).astype(np.int64))
            cell = d * m + segment
            order = np.lexsort((rare, cell))
            c = c[order]
            low = c & np.uint64(0xFFFFFFFF)
            cells = (np.nonzero(signs)[0][:, None] * m + np.arange(m)).ravel()
            n = np.bincount(cell, minlength=len(ids) * m)[cells]
            first = np.cumsum(n) - n
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low, dtype=np.uint64)])
            sums = total[first + n] - total[first]
            salt = _mix(np.arange(m, dtype=np.uint64) + np.uint64(m << 20))[cells % m]
            padded = np.append(c, np.zeros(2, np.uint64))
            with np.errstate(over="ignore"):
                rarest = _mix(salt + np.where(n > 0, padded[first], np.uint64(0)))
                some = n > 0
                second = _mix(salt + np.where(n > 1, padded[first + 1], np.uint64(0)))[some]
            yield _rows(rarest, head[cells // m], n, low.astype(np.uint32))
            without = head[cells[some] // m]
            without[:, 2] |= WITHOUT
            rest = np.ascontiguousarray(sums[some] - low[first[some]])
            yield _rows(second, without, np.full(len(rest), 2), rest.view(np.uint32))


def _signed(bucket: np.ndarray, rows: pa.Array) -> tuple:
    """(sig, row, ids, sizes, words): the signatures of routed rows; the last bit of sig is 0 for a whole segment, 1 for one without a term."""
    rows = rows.cast(pa.binary())
    start = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64) // 4
    data = np.frombuffer(rows.buffers()[2], np.uint32)
    head = data[start[:-1, None] + np.arange(HEAD)]
    ids = np.ascontiguousarray(head[:, :2]).view(np.int64).ravel()
    words = np.ascontiguousarray(head[:, 3:]).view(np.uint64)
    sizes = (head[:, 2] & ~WITHOUT).astype(np.int64)
    less = head[:, 2] & WITHOUT != 0
    full = np.nonzero(~less)[0]
    n = np.diff(start)[full] - HEAD
    first = np.cumsum(n) - n
    low = data[np.repeat(start[full] + HEAD - first, n) + np.arange(int(n.sum()))].astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low, dtype=np.uint64)])
    sums = total[first + n] - total[first]
    later = np.ones(len(low), bool)
    later[first[n > 0]] = False
    of = np.repeat(np.arange(len(full)), n)[later]
    rest = np.ascontiguousarray(data[start[:-1][less][:, None] + np.arange(HEAD, HEAD + 2)]).view(np.uint64).ravel()
    row = np.concatenate([full, full[of], np.nonzero(less)[0]])
    sig = _mix(bucket.view(np.uint64)[row] ^ _mix(np.concatenate([sums, sums[of] - low[later], rest])))
    sig = np.concatenate([sig[: len(full)] & ~np.uint64(1), sig[len(full) :] | np.uint64(1)])
    return sig, row, ids, sizes, [words[:, w] for w in range(SKETCH_WORDS)]


def _near(sig: np.ndarray, row: np.ndarray, ids: np.ndarray, sizes: np.ndarray, words: list[np.ndarray], threshold: float, carried: int = 0) -> np.ndarray:
    """The pairs of ids that pass the size and sketch tests, of signatures in order; ``row`` leads from a signature to its ids, sizes and words.

    Whole segments come first under each signature, so every match is a whole segment with a later row. The first ``carried`` are not matched
    with each other. Matches are tested in vectors, those of a crowded signature as one block.
    """
    key = sig | sig.dtype.type(1)
    ends = np.append(np.nonzero(key[1:] != key[:-1])[0] + 1, len(key))
    sizes_of = np.diff(ends, prepend=0)
    begins = ends - sizes_of
    whole = sig & sig.dtype.type(1) == 0
    first = np.maximum(np.arange(len(key)) + 1, carried)
    count = np.where(whole, np.maximum(np.repeat(ends, sizes_of) - first, 0), 0)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for g in np.nonzero(np.add.reduceat(count, begins) >= BLOCK_PAIRS)[0].tolist():
        begin, stop = int(begins[g]), int(ends[g])
        inner = begin + int(whole[begin:stop].sum())
        after = max(begin, carried)
        most = int(difference_bound(sizes[row[begin:inner]].max(), sizes[row[after:stop]].max(), threshold))
        right, rows = [w[row[after:stop]] for w in words], max(1, CHUNK // (stop - after))
        for top in range(begin, inner, rows):
            apart = sum(np.bitwise_count(w[row[top : min(top + rows, inner)], None] ^ r[None, :]) for w, r in zip(words, right))
            i, j = np.nonzero(apart <= most)
            found.append((row[i + top], row[j + after]))
        count[begin:stop] = 0
    lefts = np.nonzero(count)[0]
    left_count = count[lefts]
    total = np.cumsum(left_count)
    start = 0
    while start < len(lefts):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + CHUNK, side="right")))
        n = left_count[start:stop]
        i = row[np.repeat(lefts[start:stop], n)]
        j = row[np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first[lefts[start:stop]], n)]
        start = stop
        apart = sum(np.bitwise_count(w[i] ^ w[j]) for w in words)
        near = np.nonzero(apart <= int(difference_bound(sizes[i].max(), sizes[j].max(), threshold)))[0]
        found.append((i[near], j[near]))
    if not found:
        return np.zeros((2, 0), np.int64)
    i, j = (np.concatenate(x) for x in zip(*found))
    apart = sum(np.bitwise_count(w[i] ^ w[j]) for w in words)
    fit = (apart <= difference_bound(sizes[i], sizes[j], threshold)) & (ids[i] != ids[j]) & (np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9)
    i, j = i[fit], j[fit]
    return np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=1)


def _bucket_pairs(batches, threshold: float, hot_rows: int):
    """From routed rows in order of bucket: rows (a, b) with a null size for the near pairs of a bucket, and for a bucket of more than
    ``hot_rows`` rows its signatures (sig, id, size, sketch) for a second round. A task holds the rows of one bucket at most, and no more than that number."""

    def pairs(bucket, rows):
        sig, row, *rest = _signed(bucket, rows)
        order = np.argsort(sig)
        a, b = _near(sig[order], row[order], *rest, threshold)
        if len(a):
            nothing = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), *[nothing] * SKETCH_WORDS], names=names)

    def deferred(bucket, rows):
        sig, row, ids, sizes, words = _signed(bucket, rows)
        yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[row]), pa.array(sizes[row].astype(np.int32)), *[pa.array(w[row].view(np.int64)) for w in words]], names=names)

    names = ["a", "b", "size", *[f"w{w}" for w in range(SKETCH_WORDS)]]
    held, hot = None, None
    for batch in batches:
        bucket, rows = batch["bucket"].to_numpy(zero_copy_only=False), batch["row"].cast(pa.binary())
        if held is not None:
            bucket, rows = np.concatenate([held[0], bucket]), pa.concat_arrays([held[1], rows])
        if not len(bucket):
            continue
        begin = int(np.searchsorted(bucket, hot, side="right")) if hot is not None else 0
        if begin:
            yield from deferred(bucket[:begin], rows[:begin])
        last = max(begin, int(np.searchsorted(bucket, bucket[-1])))
        if last > begin:
            yield from pairs(bucket[begin:last], rows[begin:last])
        if len(bucket) - last > hot_rows:
            hot = bucket[-1]
            yield from deferred(bucket[last:], rows[last:])
            last = len(bucket)
        held = (bucket[last:], rows[last:]) if last < len(bucket) else None
    if held is not None:
        yield from pairs(*held)


def _pairs(batches, threshold: float):
    """Pairs (a, b) from rows (sig, id, size, sketch) in order of sig. Between batches only the whole segments of the last signature are kept."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        carried = 0
        if held is not None and len(held[0]) and held[0][-1] | 1 == cols[0][0] | 1:
            carried = len(held[0])
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        sig, ids, sizes, *sketch = cols
        a, b = _near(sig, np.arange(len(sig)), ids, sizes.astype(np.int64), [w.view(np.uint64) for w in sketch], threshold, carried)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        last = np.nonzero((sig | 1 == sig[-1] | 1) & (sig & 1 == 0))[0]
        held = [c[last] for c in cols]


def _in_tiles(signed: DataFrame, hot_rows: int) -> DataFrame:
    """``signed`` with every row of a signature of more than ``hot_rows`` whole segments once for each pairing of its own tile with another: each two rows still meet."""
    keyed = signed.withColumn("k", F.shiftright("sig", 1))
    crowded = keyed.where(F.col("sig").bitwiseAND(1) == 0).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    rows = keyed.join(crowded.select("k", F.ceil(2 * F.col("n") / hot_rows).cast("int").alias("tiles")), "k", "left")
    own = F.pmod(F.xxhash64("id"), F.col("tiles").cast("long")).cast("int")
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    moved = F.xxhash64("k", F.least(own, F.col("other")), F.greatest(own, F.col("other"))).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("sig").bitwiseAND(1))
    return spread.select(F.when(F.col("tiles").isNull(), F.col("sig")).otherwise(moved).alias("sig"), "id", "size", *[f"w{w}" for w in range(SKETCH_WORDS)])


def similar_classes(reps: DataFrame, threshold: float, hot_rows: int = HOT) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of rows of ``reps`` (id, terms: a sorted array of distinct terms or of their 64-bit hashes) at or above ``threshold``.

    Two sets at the threshold differ in at most ``difference_bound`` terms; cut into half as many segments (and one
    more), they have a segment that differs in one term at most, hence the same signature as a whole or after the deletion of
    one term on one side. The equality join of whole signatures with whole and one-deletion signatures finds it: segments meet by
    hash of their rarest term, where the variants are formed, sorted by signature and matched in the stream. A bucket of very many rows is
    sent on by signature, and a signature of very many rows in tiles. A match goes on
    only if the sizes admit it and two 192-bit parity sketches differ in no more bits than the bound (terms that differ are
    at least as many as sketch bits that differ). The survivors are verified on their terms. Every test is exact: no
    pair at the threshold is lost.
    """
    spark = reps.sparkSession
    hashes = F.col("terms") if dict(reps.dtypes)["terms"] == "array<bigint>" else F.transform("terms", lambda t: F.xxhash64(t))
    sized = reps.select(F.col("id").cast("long").alias("id"), F.size("terms").alias("size"), hashes.alias("hashes")).where("size > 0")
    common = sized.select(F.explode("hashes").alias("h")).groupBy("h").count().orderBy(F.col("count").desc(), "h").limit(RANKED_TERMS).collect()
    ranked = np.array([r.h for r in common], np.int64)
    n_rows = sized.agg(F.sum("size")).first()[0] or 0  # about as many as there are rows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / PARTITION_ROWS))
    routed = sized.mapInArrow(lambda it: _routed(it, ranked, threshold), "bucket long, row binary")
    ordered = routed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    first = written(ordered.mapInArrow(lambda it: _bucket_pairs(it, threshold, hot_rows), _FOUND))
    matched = first.where("size IS NULL").select("a", "b")
    signed = first.where("size IS NOT NULL").withColumnsRenamed({"a": "sig", "b": "id"})
    if not signed.isEmpty():
        again = _in_tiles(signed, hot_rows).repartition(parts, F.shiftright("sig", 1)).sortWithinPartitions("sig")
        matched = matched.unionByName(again.mapInArrow(lambda it: _pairs(it, threshold), "a long, b long"))
    ends = matched.distinct().select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    side = lambda c: F.max(F.when(F.col("id") == F.col(c), F.col("terms"))).alias(f"terms_{c}")
    both = ends.join(reps.select(F.col("id").cast("long").alias("id"), "terms"), "id").groupBy("a", "b").agg(side("a"), side("b"))
    exact = both.withColumn("shared", F.size(F.array_intersect("terms_a", "terms_b"))).withColumn("either", F.size("terms_a") + F.size("terms_b") - F.col("shared"))
    # In whole numbers where the threshold is given in hundredths, so that a pair exactly at it is kept.
    return exact.where(F.col("shared") * 100 >= F.col("either") * (threshold * 100) - 1e-6).select("a", "b", (F.col("shared") / F.col("either")).alias("jaccard"))


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): for every vertex of ``edges`` (a, b) the smallest vertex it is linked to.

    Labels spread to neighbours and then jump to their label's label, so the rounds grow with the logarithm of the longest chain; they
    end when no label changes. Each round is written to the checkpoint folder; only whether a label changed reaches the driver.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")))
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        spread = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(spread, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("a").alias("label"), F.col("label").alias("root"))
        jumped = durable(near.join(roots, "label", "left").select("a", "old", F.least("label", F.coalesce("root", "label")).alias("label")))
        labels = jumped.drop("old")
        if jumped.where("label <> old").isEmpty():
            return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))


def record_sets(medline: DataFrame, min_terms: int) -> DataFrame:
    """(pmid, terms): the sorted hashes (64 bits) of the distinct terms of the current records that have at least ``min_terms`` of them."""
    hashes = F.transform(record_terms(), lambda t: F.xxhash64(t))
    return current_records(medline).select("pmid", F.sort_array(F.array_distinct(hashes)).alias("terms")).where(F.size("terms") >= min_terms)


def near_duplicates(medline: DataFrame, threshold: float, min_terms: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): pmid -> rep, the smallest pmid with an equal set of terms, and the linked classes (a, b, jaccard).

    Records with fewer than ``min_terms`` terms have no class. Extra columns do not matter. Terms are compared by their 64-bit hashes and equal
    sets found by 128 bits over these. Copies fall together before the shuffle of the sets.
    """
    sets = written(record_sets(medline, min_terms).select("pmid", F.xxhash64(F.lit(1), "terms").alias("p"), F.xxhash64(F.lit(2), "terms").alias("q"), "terms"))
    prints = sets.select("pmid", "p", "q")
    members = durable(prints.join(prints.groupBy("p", "q").agg(F.min("pmid").alias("rep")), ["p", "q"]).select("pmid", "rep"))
    reps = written(sets.groupBy("p", "q").agg(F.min(F.struct("pmid", "terms")).alias("r")).select(F.col("r.pmid").alias("id"), "r.terms"))
    return members, similar_classes(reps, threshold)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of PMIDs: of linked classes every member with every member, and within a class of equal sets all pairs, as the result asks for."""
    members, links = near_duplicates(table(spark, sf_dir, "medline"), 0.7, 30)
    left, right = members.select(F.col("rep").alias("a"), F.col("pmid").alias("x")), members.select(F.col("rep").alias("b"), F.col("pmid").alias("y"))
    apart = links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    equal = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return apart.unionByName(equal).select(F.least("x", "y").alias("pmid_a"), F.greatest("x", "y").alias("pmid_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, class_id, group_id, links): one row per record with enough terms; records that resemble no other are groups of one.

    Classes are linked at the similarity of ``p4_found``; ``links`` counts the other classes its class is linked to.
    """
    members, links = near_duplicates(table(spark, sf_dir, "medline"), 0.7, 30)
    links = durable(links)
    ends = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    groups = connected(links).withColumnRenamed("id", "rep")
    return members.join(ends, "rep", "left").join(groups, "rep", "left").select(
        "pmid", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")
    )


_SETS_SQL = f"""
WITH {TERMS_SQL},
sets AS (SELECT pmid, list_distinct(terms) AS terms FROM bag WHERE len(list_distinct(terms)) >= 30)"""
_PAIRS_SQL = f"""{_SETS_SQL.replace('WITH', 'WITH RECURSIVE', 1)},
pairs AS (SELECT x.pmid AS pmid_a, y.pmid AS pmid_b, len(list_intersect(x.terms, y.terms)) AS shared, len(x.terms) + len(y.terms) AS total
          FROM sets x JOIN sets y ON x.pmid < y.pmid AND least(len(x.terms), len(y.terms)) * 10 >= greatest(len(x.terms), len(y.terms)) * 7),
near AS (SELECT pmid_a, pmid_b FROM pairs WHERE shared * 10 >= (total - shared) * 7)"""
QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
ORACLES = {
    "p4_found": f"""{_PAIRS_SQL} SELECT pmid_a, pmid_b FROM near""",
    "p4_groups": f"""{_PAIRS_SQL},
class AS (SELECT pmid, min(pmid) OVER (PARTITION BY list_sort(terms)) AS class_id FROM sets),
near_classes AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM near JOIN class a ON a.pmid = pmid_a JOIN class b ON b.pmid = pmid_b WHERE a.class_id <> b.class_id),
edges AS (SELECT a, b FROM near_classes UNION SELECT b, a FROM near_classes),
reach AS (SELECT DISTINCT class_id AS x, class_id AS y FROM class UNION SELECT x, b FROM reach JOIN edges ON a = y)
SELECT pmid, class_id, group_id, coalesce(links, 0) AS links FROM class
JOIN (SELECT x AS class_id, min(y) AS group_id FROM reach GROUP BY x) USING (class_id) LEFT JOIN (SELECT a AS class_id, count(*) AS links FROM edges GROUP BY a) USING (class_id)""",
}
