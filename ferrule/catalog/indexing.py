"""Documents, postings, statistics and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.catalog.sql import CUR, POST, number
from ferrule.functions import text as tx
from ferrule.operators import index as ix
from ferrule.operators.statistics import StatisticsSource
from ferrule.sources import readers, writers
from ferrule.tables import table


def _r(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def corpus_fields(s, d):
    docs = ix.medline_documents(s, d)
    return docs.select("doc_id", "ti", "ab", F.coalesce(F.size("mh"), F.lit(0)).alias("headings"), F.date_format("dcom", "yyyy-MM-dd").alias("dcom"))


def postings_built(s, d):
    return _r(ix.index(ix.medline_documents(s, d)), "pos")


def postings_delivered(s, d):
    return ix.delivered_postings(s, d)


def term_stats(s, d):
    return ix.term_statistics(ix.delivered_postings(s, d))


def doc_len(s, d):
    return ix.doc_lengths(ix.delivered_postings(s, d))


def avg_doc_len(s, d):
    return _r(ix.average_lengths(ix.delivered_postings(s, d)), "avg_doc_len")


def vocab_size(s, d):
    return ix.vocabulary_sizes(ix.delivered_postings(s, d))


def collection_size(s, d):
    return StatisticsSource(ix.delivered_postings(s, d)).collection_size()


def inverse_df(s, d):
    return _r(StatisticsSource(ix.delivered_postings(s, d)).inverse_document_frequency(), "idf")


def term_frequency_lookup(s, d):
    return StatisticsSource(ix.delivered_postings(s, d)).term_frequency("thrombosis", "ab")


def term_vector(s, d):
    return StatisticsSource(ix.delivered_postings(s, d)).term_vector()


def document_vector(s, d):
    return ix.document_vectors(ix.delivered_postings(s, d)).select("doc_id", F.size("terms").alias("slots"), F.md5(F.array_join("terms", "|")).alias("print"))


def clean_index(s, d):
    return ix.clean_index(ix.medline_documents(s, d))


def text_preprocessed(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.md5(tx.alpha_num("text")).alias("alpha_num"), F.md5(tx.strip_numbers("text")).alias("no_numbers"), F.length(tx.lowercase("text")).alias("n_lower"))


def text_letter_runs(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.coalesce(F.size(tx.letter_runs("text")), F.lit(0)).alias("runs"), F.md5(F.array_join(tx.letter_runs("text"), " ")).alias("print"))


def text_substring_count(s, d):
    docs = ix.medline_documents(s, d)
    return docs.select("doc_id", tx.substring_count(F.concat_ws(" ", "ti", "ab"), F.lit("patient")).alias("patient"), tx.substring_count(F.concat_ws(" ", "ti", "ab"), F.lit("in")).alias("n_in"))


def text_stems(s, d):
    words = ix.delivered_postings(s, d).where("field = 'ti'").select("term").distinct()
    return words.select("term", tx.stems(F.array("term"))[0].alias("stem"))


def keyphrases(s, d):
    docs = ix.medline_documents(s, d).select("doc_id", F.concat_ws(". ", "ti", "ab").alias("text"))
    return _r(tx.keyphrases(docs, "doc_id", "text"), "score")


def document_overlap(s, d):
    query = F.array(*[F.lit(w) for w in ("thrombosis", "after", "usual", "statin", "therapy")])
    docs = ix.medline_documents(s, d)
    return _r(docs.select("doc_id", tx.document_overlap(query, tx.terms(F.concat_ws(" ", "ti", "ab"))).alias("overlap")), "overlap")


def fetched_documents(s, d):
    docs = ix.medline_documents(s, d)
    ids = table(s, d, "term_vectors").select(F.col("pmid").alias("doc_id"))
    return readers.fetch_documents(docs, ids).select("doc_id", "ti")


def population_sample(s, d):
    return readers.population_sample(ix.medline_documents(s, d), "2015-01-01", "2022-12-31", 10_000).select("doc_id")


def trec_lines(s, d):
    return writers.trec_lines(table(s, d, "runs").where("topic IS NOT NULL AND doc_id IS NOT NULL AND rank IS NOT NULL")).select("value")


_SENT = r"regexp_split_to_array(ab, '[.!?]+\s+')"
_TERM = r"'[\p{L}\p{N}]+'"
QUERIES = {
    f.__name__: f for f in (
        corpus_fields, postings_built, postings_delivered, term_stats, doc_len, avg_doc_len, vocab_size, collection_size, inverse_df, term_frequency_lookup, term_vector, document_vector,
        clean_index, text_preprocessed, text_letter_runs, text_substring_count, text_stems, keyphrases, document_overlap, fetched_documents, population_sample, trec_lines,
    )
}
_STATS = "SELECT term, field, count(DISTINCT doc_id) AS df, sum(tf) AS ttf FROM p GROUP BY ALL"
ORACLES = {
    "corpus_fields": f"WITH {CUR} SELECT doc_id, ti, ab, coalesce(len(mh), 0) AS headings, strftime(dcom, '%Y-%m-%d') AS dcom FROM cur",
    "postings_built": f"""WITH {CUR},
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(ti), {_TERM}) AS ws FROM cur WHERE ti IS NOT NULL)),
a AS (SELECT doc_id, len(ss) AS n, i, unnest(regexp_extract_all(lower(s), {_TERM})) AS term FROM (
  SELECT doc_id, ss, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT doc_id, list_filter({_SENT}, lambda x: len(trim(x)) > 0) AS ss FROM cur WHERE ab IS NOT NULL)))
SELECT term, 'ti' AS field, doc_id, CAST(count(*) AS DOUBLE) AS tf, round(1 + (1 - min(i) / any_value(n)), 6) AS pos FROM t GROUP BY term, doc_id
UNION ALL SELECT term, 'ab', doc_id, CAST(count(*) AS DOUBLE), round(1 + (1 - min(i) / any_value(n)), 6) FROM a GROUP BY term, doc_id
UNION ALL SELECT DISTINCT lower(trim(h)), 'mh', doc_id, 1.0, 1.0 FROM (SELECT doc_id, unnest(mh) AS h FROM cur) WHERE h IS NOT NULL AND trim(h) <> ''""",
    "postings_delivered": f"WITH {POST} SELECT * FROM p",
    "term_stats": f"WITH {POST} {_STATS}",
    "doc_len": f"WITH {POST} SELECT doc_id, field, sum(tf) AS doc_len FROM p GROUP BY ALL",
    "avg_doc_len": f"WITH {POST} SELECT field, round(sum(tf) / (SELECT count(DISTINCT doc_id) FROM p), 6) AS avg_doc_len FROM p GROUP BY field",
    "vocab_size": f"WITH {POST} SELECT field, sum(tf) AS tokens, count(DISTINCT term) AS terms FROM p GROUP BY field",
    "collection_size": f"WITH {POST} SELECT count(DISTINCT doc_id) AS n FROM p",
    "inverse_df": f"WITH {POST} SELECT term, field, round(ln(((SELECT count(DISTINCT doc_id) FROM p) + 1) / (count(DISTINCT doc_id) + 1)), 6) AS idf FROM p GROUP BY term, field",
    "term_frequency_lookup": f"WITH {POST} SELECT doc_id, tf FROM p WHERE term = 'thrombosis' AND field = 'ab'",
    "term_vector": f"WITH {POST}, s AS ({_STATS}) SELECT doc_id, field, term, tf, df, ttf FROM p JOIN s USING (term, field)",
    "document_vector": f"WITH {POST} SELECT doc_id, count(*) AS slots, md5(string_agg(x, '|' ORDER BY x)) AS print FROM (SELECT doc_id, field || ':' || term AS x FROM p) GROUP BY doc_id",
    "clean_index": f"""WITH {CUR} SELECT term, doc_id, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', ti, ab)), {_TERM})) AS term FROM cur)
WHERE NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({", ".join(f"'{w}'" for w in tx.STOPWORDS)}) GROUP BY ALL""",
    "text_preprocessed": """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS alpha_num,
md5(regexp_replace(text, '[0-9]', '', 'g')) AS no_numbers, length(lower(text)) AS n_lower FROM documents""",
    "text_letter_runs": r"""SELECT doc_id, coalesce(len(x), 0) AS runs, md5(array_to_string(x, ' ')) AS print
FROM (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', ' ', 'g')), '\p{L}+') AS x FROM documents)""",
    "text_substring_count": f"""WITH {CUR}, x AS (SELECT doc_id, concat_ws(' ', ti, ab) AS t FROM cur)
SELECT doc_id, (length(t) - length(replace(t, 'patient', ''))) // 7 AS patient, (length(t) - length(replace(t, 'in', ''))) // 2 AS n_in FROM x""",
    "document_overlap": f"""WITH {CUR} SELECT doc_id, round(CASE WHEN len(x) > 0 THEN len(list_intersect(x, ['thrombosis', 'after', 'usual', 'statin', 'therapy'])) / len(x) ELSE 0 END, 6) AS overlap
FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', ti, ab)), {_TERM})) AS x FROM cur)""",
    "fetched_documents": f"WITH {CUR} SELECT doc_id, ti FROM cur WHERE doc_id IN (SELECT pmid FROM term_vectors)",
    "population_sample": f"WITH {CUR} SELECT doc_id FROM cur WHERE dcom BETWEEN DATE '2015-01-01' AND DATE '2022-12-31' ORDER BY doc_id LIMIT 10000",
    "trec_lines": f"SELECT concat_ws(' ', topic, coalesce(iteration, 'Q0'), doc_id, CAST(rank AS VARCHAR), {number('score')}, run_name) AS value FROM runs WHERE topic IS NOT NULL AND doc_id IS NOT NULL AND rank IS NOT NULL",
}
