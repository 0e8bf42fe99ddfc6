"""The streaming facade over the events and the collection's query terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.catalog.ranking import FIELDS
from ferrule.catalog.sql import POST
from ferrule.operators import index as ix
from ferrule.operators import scorers as sc
from ferrule.streaming import facade as st


def _events(s, d):
    return st.read_stream(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_event_windows(s, d):
    counted = st.windowed_counts(_events(s, d), "ts", ["event_type"], "1 hour")
    return st.run_to_table(counted, "complete").withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_sessions(s, d):
    return st.run_to_table(st.sessions(_events(s, d), "ts", "user_id", "6 hours", late=None), "complete").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


def stream_matches(s, d):
    """Subjects' names as a stream of one-term queries, matched against the postings."""
    terms = st.read_stream(s, f"{d}/subjects.parquet").select(F.col("subject").alias("topic"), F.explode(F.split(F.lower("description"), "[^a-z]+")).alias("term")).where("term <> ''")
    return st.run_to_table(st.matched_stream(terms, sc.Collection(ix.delivered_postings(s, d)), FIELDS)).groupBy("topic").agg(F.count_distinct("doc_id").alias("docs"), F.sum("tf").alias("occurrences"))


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_sessions, stream_matches)}
ORACLES = {
    "stream_event_windows": "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "stream_sessions": """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts < p + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, g""",
    "stream_matches": rf"""WITH {POST}, t AS (SELECT subject AS topic, unnest(regexp_extract_all(lower(description), '[a-z]+')) AS term FROM subjects)
SELECT topic, count(DISTINCT doc_id) AS docs, sum(tf) AS occurrences FROM t JOIN p USING (term) WHERE field IN ('ti', 'ab') GROUP BY topic""",
}
