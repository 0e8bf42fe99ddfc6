"""Problem 9: the subject areas of documents, by matching curated weighted terms with one automaton."""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.tables import durable, table

#: Lines of ``subject <tab> language <tab> terms``, the terms separated by semicolons.
VOCABULARY = Path(__file__).parent / "data" / "subject_terms.tsv"
#: Ends of sentences and lines; paragraph marks count as line ends.
BOUNDARY = re.compile(r"(?<=[.!?])\s+|[\r\n]+|</?(?:p|br|li|div|h[1-6])\b[^>]*>", re.IGNORECASE)
TAG = re.compile(r"<[^<>]{1,80}>")
WORD = re.compile(r"[^\W_]+")
THRESHOLDS = [i / 20 for i in range(1, 17)]
_TERMS = "terms array<struct<term:string,tf:int,at:int>>"
_SCHEMA = f"words int, sentences int, dealing int, subjects array<struct<subject:string,share_sentences:int,{_TERMS.replace(' ', ':')}>>"


def vocabulary(path: str | Path = VOCABULARY) -> list[tuple[str, str, float]]:
    """(subject, term, weight) of the file; terms in lower case with words joined by one blank. A term of two languages occurs once, with its larger weight."""
    rows = (line.rstrip("\n").split("\t") for line in open(path, encoding="utf-8") if line.strip() and not line.startswith("#"))
    held: dict[tuple[str, str], float] = {}
    for subject, _, weight, terms in rows:
        for t in filter(None, (" ".join(WORD.findall(t.lower())) for t in terms.split(";"))):
            held[subject, t] = max(float(weight), held.get((subject, t), 0.0))
    return sorted((s, t, w) for (s, t), w in held.items())


def longest(hits: list[tuple[int, int, str]]) -> list[str]:
    """The terms of the hits (start, end, term) that lie within no longer hit: in order of start, the longer first, one is within another if the furthest end so far covers it."""
    kept, furthest = [], -1
    for start, end, term in sorted(hits, key=lambda h: (h[0], -h[1])):
        if end > furthest:
            kept.append(term)
            furthest = end
    return kept


def _matches(batches, key: str, terms: list[tuple[str, str, float]]):
    """Per document the subjects found in it: the sentences that deal with each, and the counts of its terms.

    Each sentence is reduced to its words, so case, markup, hyphens and odd white space between the words of a term do not matter.
    The automaton finds all terms in one pass; of one hit within another the longer counts.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    by_term: dict[str, list[str]] = {}
    number: dict[tuple[str, str], int] = {}
    for i, (subject, term, _) in enumerate(terms):
        by_term.setdefault(term, []).append(subject)
        number[subject, term] = i
    for term in by_term:
        automaton.add_word(f" {term} ", term)
    automaton.make_automaton()
    kind = pa.list_(pa.struct([("subject", pa.string()), ("share_sentences", pa.int32()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32()), ("at", pa.int32())])))]))
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for text in batch["__text"].to_pylist():
            n_words = n_sentences = dealing = 0
            sentences: dict[str, int] = {}
            counts: dict[str, dict[str, int]] = {}
            for part in BOUNDARY.split(text or ""):
                words = WORD.findall(TAG.sub(" ", part).lower())
                if not words:
                    continue
                n_words, n_sentences = n_words + len(words), n_sentences + 1
                here: set[str] = set()
                for term in longest([(end - len(t), end, t) for end, t in automaton.iter(f" {' '.join(words)} ")]):
                    for subject in by_term[term]:
                        here.add(subject)
                        of = counts.setdefault(subject, {})
                        of[term] = of.get(term, 0) + 1
                dealing += bool(here)
                for subject in here:
                    sentences[subject] = sentences.get(subject, 0) + 1
            found = [{"subject": s, "share_sentences": n, "terms": [{"term": t, "tf": k, "at": number[s, t]} for t, k in counts[s].items()]} for s, n in sentences.items()]
            for column, value in zip(columns, (n_words, n_sentences, dealing, found)):
                column.append(value)
        arrays = [pa.array(v, k) for v, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), kind))]
        yield pa.RecordBatch.from_arrays([batch[key], *arrays], names=[key, "words", "sentences", "dealing", "subjects"])


def document_matches(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | Path = VOCABULARY) -> DataFrame:
    """(key, words, sentences, dealing, subjects): one row per document; ``subjects`` has (subject, share_sentences, terms (term, tf, at)), ``at`` the number of the
    subject's term in the vocabulary.

    ``dealing`` counts the sentences or lines with any subject, ``share_sentences`` those with this one. Texts without a
    subject, null and empty ones included, have an empty array.
    """
    terms = vocabulary(path)
    kind = documents.select(key).schema.simpleString()[7:-1]
    return documents.select(key, documents[text].alias("__text")).mapInArrow(lambda it: _matches(it, key, terms), f"{kind}, {_SCHEMA}")


def subject_matches(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | Path = VOCABULARY) -> DataFrame:
    """``document_matches`` with a row per document and subject; a text without a subject has one row with a null subject."""
    rows = document_matches(documents, key, text, path).select(key, "words", "sentences", "dealing", F.explode_outer("subjects").alias("s"))
    return rows.select(key, "words", "sentences", "dealing", "s.subject", F.coalesce("s.share_sentences", F.lit(0)).alias("share_sentences"), F.coalesce("s.terms", F.array().cast(_TERMS[6:])).alias("terms"))


def weighted_subjects(matches: DataFrame, key: str = "doc_id", path: str | Path = VOCABULARY) -> DataFrame:
    """(key, words, sentences, dealing, subject, share_sentences, score, share) from ``document_matches``.

    score is the sum over the subject's terms of weight x rarity x tf, per 100 words of the text; share its part of the document's scores.
    weight is that of the vocabulary; rarity = ln(1 + N / df) with df the number of documents with the term and N that of all documents:
    rarer terms say more. Rarities are one row, bounded by the vocabulary, so scoring needs no shuffle of documents.
    """
    seen = matches.select(F.explode(F.array_distinct(F.flatten(F.transform("subjects", lambda s: F.transform(s["terms"], lambda t: t["term"]))))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = matches.agg(F.count(F.lit(1)).alias("n"))
    known = matches.sparkSession.createDataFrame([(i, t, w) for i, (_, t, w) in enumerate(vocabulary(path))], "at int, term string, weight double")
    value = F.coalesce(F.round(F.col("weight") * F.log(1 + F.col("n") / F.col("df")), 9), F.lit(0.0)).alias("value")
    rare = known.join(seen, "term", "left").crossJoin(F.broadcast(total)).agg(F.array_sort(F.collect_list(F.struct("at", value))).alias("pairs")).select(F.transform("pairs", lambda p: p["value"]).alias("values"))
    sums = F.transform("subjects", lambda s: F.struct(
        s["subject"].alias("subject"), s["share_sentences"].alias("share_sentences"),
        F.aggregate(s["terms"], F.lit(0.0), lambda a, t: a + t["tf"] * F.get("values", t["at"])).alias("sum"),
    ))
    scored = matches.where(F.size("subjects") > 0).crossJoin(F.broadcast(rare)).select(key, "words", "sentences", "dealing", sums.alias("sums"))  # one row of as many entries as the vocabulary
    every = scored.withColumn("all", F.aggregate("sums", F.lit(0.0), lambda a, s: a + s["sum"])).select("*", F.explode("sums").alias("s"))
    return every.select(key, "words", "sentences", "dealing", "s.subject", "s.share_sentences", (F.col("s.sum") * 100 / F.col("words")).alias("score"), F.round(F.col("s.sum") / F.col("all"), 9).alias("share"))


def judged_shares(shares: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, subject, share, label) of the labelled documents: every subject found or labelled, share 0 where it was not found; null labels do not count."""
    given = labels.where(f"{key} IS NOT NULL AND subject IS NOT NULL").select(key, F.lower(F.trim("subject")).alias("subject")).distinct().withColumn("label", F.lit(1))
    there = shares.select(key, "subject", "share").join(given.select(key).distinct(), key, "left_semi")
    return there.join(given, [key, "subject"], "full").select(key, "subject", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("label", F.lit(0)).alias("label"))


def calibrated(shares: DataFrame, labels: DataFrame, key: str = "doc_id", default: float = 0.3) -> DataFrame:
    """(subject, threshold): of ``THRESHOLDS``, the one with the best F1 against the labels of each subject, the larger of equal ones.

    All labelled documents count; null labels do not. A subject without labels has ``default``.
    """
    judged = judged_shares(shares, labels, key)
    tried = judged.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS)))).withColumn("said", (F.col("share") >= F.col("threshold")).cast("int"))
    f1 = F.round(2 * F.sum(F.col("said") * F.col("label")) / F.greatest(F.sum("said") + F.sum("label"), F.lit(1)), 9)
    per = tried.groupBy("subject", "threshold").agg(f1.alias("f1"), F.sum("label").alias("labels"))
    return per.groupBy("subject").agg(F.max(F.struct("f1", "threshold")).alias("best"), F.max("labels").alias("labels")).select("subject", F.when(F.col("labels") > 0, F.col("best.threshold")).otherwise(default).alias("threshold"))


def calibrated_candidates(shares: DataFrame, labels: DataFrame, key: str = "doc_id", keep: float = 0.995, margin: float = 1 / 3, most: float = 0.3, default: float = 0.05) -> DataFrame:
    """(subject, threshold): ``margin`` times the largest of ``THRESHOLDS`` up to ``most`` that at least ``keep`` of the subject's labelled documents that mention it reach, else ``default``."""
    judged = judged_shares(shares, labels, key).where("label = 1 AND share > 0")
    reached = F.when(F.avg((F.col("share") >= F.col("threshold")).cast("double")) >= keep, F.first("threshold"))
    tried = judged.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in THRESHOLDS if t <= most)))).groupBy("subject", "threshold").agg(reached.alias("reached"))
    return tried.groupBy("subject").agg(F.coalesce(F.round(margin * F.max("reached"), 9), F.lit(default)).alias("threshold"))


def above(shares: DataFrame, limits: DataFrame, default: float) -> DataFrame:
    """The rows of ``shares`` whose share reaches their subject's threshold, ``default`` where it has none; one row a subject is broadcast."""
    return shares.join(F.broadcast(limits), "subject", "left").where(F.col("share") >= F.coalesce("threshold", F.lit(default)))


def assigned(documents: DataFrame, labels: DataFrame, key: str = "doc_id", default: float = 0.3) -> DataFrame:
    """(key, subject, score, share): every subject of a document whose share reaches the subject's calibrated threshold."""
    shares = weighted_subjects(durable(document_matches(documents, key)), key)
    return above(shares, calibrated(shares, labels, key, default), default).select(key, "subject", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"))


def dealt_with(matches: DataFrame, labels: DataFrame, key: str = "doc_id", least: float = 0.05) -> DataFrame:
    """The rows of ``weighted_subjects`` of the subjects that at least a third of the sentences dealing with any deal with.

    They are found by their weighted share against thresholds calibrated to keep the labelled documents; the third is then checked on what is found.
    """
    shares = weighted_subjects(matches, key)
    return above(shares, calibrated_candidates(shares, labels, key, default=least), least).where("share_sentences * 3 >= dealing")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = durable(document_matches(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")))
    return dealt_with(matches, table(spark, sf_dir, "subject_labels")).select("doc_id", "subject").distinct()


def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, documents, words): the corpus by subject, a document with several subjects counted in each; none is ``(none)``."""
    matches = durable(document_matches(table(spark, sf_dir, "documents")))
    found = dealt_with(matches, table(spark, sf_dir, "subject_labels")).select("subject", "words")
    none = matches.where("size(subjects) = 0").select(F.lit("(none)").alias("subject"), "words")
    return found.unionByName(none).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"))


def p9_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, threshold, labels, said, both): thresholds with the best F1 on the labelled documents of even number, counted on those of odd number."""
    labels = table(spark, sf_dir, "subject_labels")
    shares = weighted_subjects(durable(document_matches(table(spark, sf_dir, "documents"))))
    limits = calibrated(shares, labels.where("doc_id % 2 = 0"), "doc_id")
    judged = judged_shares(shares, labels.where("doc_id % 2 <> 0")).join(F.broadcast(limits), "subject", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.3)))  # one row a subject
    said = F.col("share") >= F.col("threshold")
    return judged.groupBy("subject", "threshold").agg(F.sum("label").alias("labels"), F.count_if(said).alias("said"), F.count_if(said & (F.col("label") == 1)).alias("both"))


def _sql() -> str:
    """Shares of every document in SQL: sentences by regular expression, each held against every term of the vocabulary (none of which lies within another)."""
    values = ", ".join("('{}', '{}', {})".format(s, t.replace("'", "''"), w) for s, t, w in vocabulary())
    return rf"""
WITH v(subject, term, weight) AS (VALUES {values}),
parts AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])[\s\x0b\x85\p{{Z}}]+', '\1' || chr(10), 'g'), '[\r\n]+|</?(p|br|li|div|h[1-6])\b[^>]*>', chr(10), 'gi'), chr(10))) AS part FROM documents),
worded AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(part, '<[^<>]{{1,80}}>', ' ', 'g')), '[\p{{L}}\p{{N}}]+') AS w FROM parts),
sent AS (SELECT doc_id, row_number() OVER () AS i, len(w) AS n, ' ' || array_to_string(w, '  ') || ' ' AS x FROM worded WHERE len(w) > 0),
h AS (SELECT doc_id, i, subject, term, weight, (length(x) - length(replace(x, t, ''))) // length(t) AS tf FROM sent JOIN (SELECT *, ' ' || replace(term, ' ', '  ') || ' ' AS t FROM v) ON contains(x, t)),
d AS (SELECT doc_id, sum(n) AS words FROM sent GROUP BY doc_id), n AS (SELECT count(*) AS n FROM documents),
deal AS (SELECT doc_id, count(DISTINCT i) AS dealing FROM h GROUP BY doc_id),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM h GROUP BY term),
m AS (SELECT doc_id, subject, count(DISTINCT i) AS share_sentences, sum(tf * round(weight * ln(1 + n / df), 9)) AS s FROM h JOIN df USING (term) CROSS JOIN n GROUP BY ALL),
shares AS (SELECT doc_id, words, dealing, subject, share_sentences, s * 100 / words AS score, round(s / sum(s) OVER (PARTITION BY doc_id), 9) AS share FROM m JOIN d USING (doc_id) JOIN deal USING (doc_id)),
given AS (SELECT DISTINCT doc_id, lower(trim(subject)) AS subject FROM subject_labels WHERE doc_id IS NOT NULL AND subject IS NOT NULL),
judged AS (SELECT doc_id, subject, coalesce(s.share, 0) AS share, CASE WHEN g.subject IS NULL THEN 0 ELSE 1 END AS label
  FROM (SELECT * FROM shares WHERE doc_id IN (SELECT doc_id FROM given)) s FULL JOIN given g USING (doc_id, subject)),
t AS (SELECT i / 20 AS threshold FROM range(1, 17) r(i)),
tried AS (SELECT judged.*, threshold, share >= threshold AS said FROM judged CROSS JOIN t),
best AS (SELECT subject, threshold FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY f1 DESC, threshold DESC) AS k FROM (
  SELECT subject, threshold, round(2 * sum(said::INT * label) / greatest(sum(said::INT) + sum(label), 1), 9) AS f1 FROM tried GROUP BY ALL)) WHERE k = 1),
kept AS (SELECT subject, round(max(CASE WHEN r >= 0.995 AND threshold <= 0.3 THEN threshold END) / 3, 9) AS threshold FROM (
  SELECT subject, threshold, avg(said::INT) AS r FROM tried WHERE label = 1 AND share > 0 GROUP BY ALL) GROUP BY subject),
found AS (SELECT shares.* FROM shares LEFT JOIN kept USING (subject) WHERE share >= coalesce(threshold, 0.05) AND share_sentences * 3 >= dealing)
"""


QUERIES = {"p9_found": p9_found, "p9_subjects": p9_subjects, "p9_composition": p9_composition, "p9_held_out": p9_held_out}
ORACLES = {
    "p9_found": f"{_sql()} SELECT DISTINCT doc_id, subject FROM found WHERE doc_id IS NOT NULL",
    "p9_subjects": f"{_sql()} SELECT doc_id, subject, round(score, 6) AS score, round(share, 6) AS share FROM shares LEFT JOIN best USING (subject) WHERE share >= coalesce(threshold, 0.3)",
    "p9_composition": f"""{_sql()} SELECT subject, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words FROM (SELECT subject, words FROM found
UNION ALL SELECT '(none)', coalesce(words, 0) FROM documents LEFT JOIN d USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM h)) GROUP BY subject""",
}
