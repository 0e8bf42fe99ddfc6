"""Evaluation of the runs. Judgements: the pool of the first 50 of every run, graded by document number modulo 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.catalog.sql import CUR, QRELS, RUN
from ferrule.operators import evaluate as ev
from ferrule.operators import index as ix
from ferrule.sources import writers
from ferrule.tables import table

SIZE = 5_000_000


def pooled(run, depth: int = 50):
    return run.where(F.col("rn") <= depth).select("topic", "doc_id", (F.col("doc_id") % 3).alias("grade")).distinct()


def _data(s, d):
    run = ev.ranked(table(s, d, "runs"))
    return run, pooled(run)


def _r(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def eval_ranked(s, d):
    return ev.ranked(table(s, d, "runs"))


def eval_counts(s, d):
    return ev.counts(*_data(s, d))


def eval_precision_recall(s, d):
    return _r(ev.precision_recall(ev.counts(*_data(s, d))).select(*ev.KEYS, "precision", "recall"), "precision", "recall")


def eval_precision_compat(s, d):
    return _r(ev.precision_recall(ev.counts(*_data(s, d), 1), compat=True).select(*ev.KEYS, "precision"), "precision")


def eval_f_measures(s, d):
    c = ev.precision_recall(ev.counts(*_data(s, d)))
    return _r(c.select(*ev.KEYS, ev.f_measure(1).alias("f1"), ev.f_measure(0.5).alias("f05"), ev.f_measure(3).alias("f3")), "f1", "f05", "f3")


def eval_at_k(s, d):
    return _r(ev.at_k(*_data(s, d), [5, 10, 100]), *[f"{n}_{k}" for n in ("p", "recall") for k in (5, 10, 100)])


def eval_ap(s, d):
    return _r(ev.average_precision(*_data(s, d)), "ap")


def eval_dcg_ndcg(s, d):
    return _r(ev.dcg(*_data(s, d), [10, 100, 0]), *[f"{n}_{k}" for n in ("dcg", "ndcg") for k in (10, 100, 0)])


def eval_wss_nnr(s, d):
    c = ev.precision_recall(ev.counts(*_data(s, d)))
    return _r(c.select(*ev.KEYS, ev.wss(SIZE).alias("wss"), ev.nnr().alias("nnr")), "wss", "nnr")


def eval_residual(s, d):
    return _r(ev.precision_recall(ev.residual_counts(*_data(s, d))), "precision", "recall")


def eval_mle(s, d):
    return _r(ev.precision_recall(ev.mle_counts(*_data(s, d))), "precision", "recall")


def eval_summary(s, d):
    run, qrels = _data(s, d)
    names = ["precision", "recall", "f1", "num_rel_ret", "p@10", "ndcg@10", "ap"]
    known = ev.registry(SIZE)
    return _r(ev.summary(ev.evaluate(run, qrels, {n: known[n] for n in names})), "mean")


def eval_all_measures(s, d):
    """(topic, run_name, name, value): every measure of the registry, the residual and maximum-likelihood ones included."""
    return _r(ev.evaluate(*_data(s, d), ev.registry(SIZE)), "value")


def eval_wide(s, d):
    """The measures of every run and topic as a row, as the evaluation writer lays them out."""
    run, qrels = _data(s, d)
    known = ev.registry(SIZE)
    long = ev.evaluate(run, qrels, {n: known[n] for n in ("precision", "recall")}).withColumn("list", F.concat_ws("/", F.coalesce("run_name", F.lit("-")), "topic"))
    return _r(writers.wide(long, "list", "name", "value", ["precision", "recall"]), "precision", "recall")


def dedup_title(s, d):
    docs = ix.medline_documents(s, d)
    run = docs.select(F.lit("all").alias("topic"), F.lit("by_id").alias("run_name"), "doc_id", F.lit(0.0).alias("score"), F.col("doc_id").alias("rn"))
    return ev.deduplicate_titles(run, docs).select("topic", "doc_id")


QUERIES = {f.__name__: f for f in (eval_ranked, eval_counts, eval_precision_recall, eval_precision_compat, eval_f_measures, eval_at_k, eval_ap, eval_dcg_ndcg, eval_wss_nnr, eval_residual, eval_mle, eval_summary, eval_all_measures, eval_wide, dedup_title)}
_J = f"{RUN}, {QRELS}, j AS (SELECT r.*, q.grade FROM r LEFT JOIN q USING (topic, doc_id))"


def _counts(grade: int = 0) -> str:
    return f"""c AS (SELECT topic, run_name, num_ret, coalesce(num_rel, 0) AS num_rel, num_rel_ret, coalesce(num_nonrel, 0) AS num_nonrel FROM (
  SELECT topic, run_name, count(*) AS num_ret, count(*) FILTER (grade > {grade}) AS num_rel_ret FROM j GROUP BY ALL) LEFT JOIN (
  SELECT topic, count(*) FILTER (grade > {grade}) AS num_rel, count(*) FILTER (grade <= {grade}) AS num_nonrel FROM q GROUP BY topic) USING (topic))"""


_PR = "pr AS (SELECT *, num_rel_ret / num_ret AS p, CASE WHEN num_rel > 0 THEN num_rel_ret / num_rel ELSE 0 END AS rc FROM c)"


def _f(b: float) -> str:
    return f"round(CASE WHEN p > 0 AND rc > 0 THEN {1 + b * b} * p * rc / ({b * b} * p + rc) ELSE 0 END, 6)"


def _dcg(k: int) -> str:
    return f"sum(CASE WHEN {f'rn <= {k}' if k else 'true'} THEN coalesce(grade, 0) / log2(rn + 1) ELSE 0 END)"


_AP = """ap AS (SELECT topic, run_name, coalesce(s / n, 0) AS ap FROM (SELECT DISTINCT topic, run_name FROM r)
LEFT JOIN (SELECT topic, run_name, sum(k / rn) AS s FROM (SELECT topic, run_name, rn, row_number() OVER (PARTITION BY topic, run_name ORDER BY rn) AS k FROM j WHERE grade > 0) GROUP BY ALL) USING (topic, run_name)
LEFT JOIN (SELECT topic, count(*) AS n FROM q WHERE grade > 0 GROUP BY topic) USING (topic))"""
_IDEAL = "ideal AS (SELECT topic, {} FROM (SELECT topic, grade, row_number() OVER (PARTITION BY topic ORDER BY grade DESC, doc_id) AS rn FROM q) GROUP BY topic)"
_ND = f"""g AS (SELECT topic, run_name, {_dcg(10)} AS d10, {_dcg(100)} AS d100, {_dcg(0)} AS d0 FROM j GROUP BY ALL), {_IDEAL.format(f'{_dcg(10)} AS i10, {_dcg(100)} AS i100, {_dcg(0)} AS i0')}"""
_SHARED = """SELECT topic, run_name, num_ret, num_rel_ret, num_rel, round(num_rel_ret / num_ret, 6) AS precision, round(CASE WHEN num_rel > 0 THEN num_rel_ret / num_rel ELSE 0 END, 6) AS recall FROM x"""
_TOPIC = "t AS (SELECT topic, count(*) FILTER (grade > 0) AS rel, count(*) FILTER (grade <= 0) AS nonrel FROM q GROUP BY topic)"
_PER = "u AS (SELECT topic, run_name, count(*) AS num_ret, count(*) FILTER (grade > 0) AS hit, count(*) FILTER (grade IS NULL) AS un FROM j GROUP BY ALL)"


def _every_measure() -> str:
    """All measures in SQL: per variant the judged run with its own grades, and the ideal order of the topic's and the added documents."""
    parts, rows = [], ["SELECT topic, run_name, 'num_ret' AS name, num_ret AS value FROM s0", "SELECT topic, run_name, 'num_rel', num_rel FROM s0", "SELECT topic, run_name, 'num_rel_ret', rr FROM s0"]
    for i, (v, taken) in enumerate((("", "false"), ("_res", "un"), ("_mle", "un AND uns <= likely"))):
        h, r = " , ".join(f"count(*) FILTER (rel AND rn <= {k}) AS h{k}" for k in (10, 100, 1000)), (5, 10, 100, 200, 500)
        parts.append(f"""v{i} AS (SELECT *, row_number() OVER (PARTITION BY topic, run_name, rel ORDER BY rn) AS k FROM (SELECT topic, run_name, rn, un, CASE WHEN {taken} THEN 1 ELSE coalesce(grade, 0) END AS g,
  coalesce(grade > 0, false) OR ({taken}) AS rel, ({taken}) AS added FROM f)),
i{i} AS (SELECT topic, run_name, {', '.join(f'sum(CASE WHEN x <= {k} THEN grade / log2(x + 1) ELSE 0 END) AS i{k}' for k in r)} FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, run_name ORDER BY grade DESC) AS x FROM (
    SELECT l.topic, l.run_name, grade FROM lists l JOIN q USING (topic) UNION ALL SELECT topic, run_name, 1 FROM v{i} WHERE added)) GROUP BY ALL),
s{i} AS (SELECT a.*, coalesce(nr, 0) + ad AS num_rel, {', '.join(f'i{k}' for k in r)} FROM (SELECT topic, run_name, count(*) AS num_ret, count(*) FILTER (rel) AS rr, count(*) FILTER (added) AS ad, coalesce(sum(k / rn) FILTER (rel), 0) AS ps, {h},
  {', '.join(f'sum(CASE WHEN rn <= {k} THEN g / log2(rn + 1) ELSE 0 END) AS d{k}' for k in r)} FROM v{i} GROUP BY ALL) a LEFT JOIN (SELECT topic, count(*) FILTER (grade > 0) AS nr FROM q GROUP BY topic) USING (topic) LEFT JOIN i{i} USING (topic, run_name)),
r{i} AS (SELECT *, rr / num_ret AS p, CASE WHEN num_rel > 0 THEN rr / num_rel ELSE 0 END AS rc FROM s{i})""")
        named = {"precision": "p", "recall": "rc", "wss": f"({SIZE} - num_ret) / {SIZE} - (1 - rc)", "nnr": "(num_ret + 1) / (rr + 1)", "ap": "CASE WHEN num_rel > 0 THEN ps / num_rel ELSE 0 END"}
        named |= {f"f{b:g}": f"CASE WHEN p > 0 AND rc > 0 THEN {1 + b * b} * p * rc / ({b * b} * p + rc) ELSE 0 END" for b in (0.5, 1.0, 3.0)}
        named |= {f"p@{k}": f"h{k} / {k}" for k in (10, 100, 1000)} | {f"recall@{k}": f"CASE WHEN num_rel > 0 THEN h{k} / num_rel ELSE 0 END" for k in (10, 100, 1000)}
        named |= {f"ndcg@{k}": f"CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 0 END" for k in r}
        rows += [f"SELECT topic, run_name, '{name}{v}', {value} FROM r{i}" for name, value in named.items()]
    return f"""WITH {_J}, t AS (SELECT topic, floor((count(*) FILTER (grade > 0) + 1) / (count(*) FILTER (grade <= 0) + 1)) AS likely FROM q GROUP BY topic), lists AS (SELECT DISTINCT topic, run_name FROM r),
f AS (SELECT *, sum(un::INT) OVER (PARTITION BY topic, run_name ORDER BY rn) AS uns FROM (SELECT topic, run_name, rn, grade, grade IS NULL AS un, coalesce(likely, 1) AS likely FROM j LEFT JOIN t USING (topic))),
{', '.join(parts)} SELECT topic, run_name, name, round(value, 6) AS value FROM ({' UNION ALL '.join(rows)})"""


ORACLES = {
    "eval_ranked": f"WITH {RUN} SELECT * FROM r",
    "eval_counts": f"WITH {_J}, {_counts()} SELECT * FROM c",
    "eval_precision_recall": f"WITH {_J}, {_counts()}, {_PR} SELECT topic, run_name, round(p, 6) AS precision, round(rc, 6) AS recall FROM pr",
    "eval_precision_compat": f"WITH {_J}, {_counts(1)} SELECT topic, run_name, round(CASE WHEN num_rel_ret = num_ret THEN 0 ELSE num_rel_ret / num_ret END, 6) AS precision FROM c",
    "eval_f_measures": f"WITH {_J}, {_counts()}, {_PR} SELECT topic, run_name, {_f(1)} AS f1, {_f(0.5)} AS f05, {_f(3)} AS f3 FROM pr",
    "eval_at_k": f"WITH {_J} SELECT topic, run_name, " + ", ".join(f"round(h{k} / {k}, 6) AS p_{k}, round(CASE WHEN coalesce(n, 0) > 0 THEN h{k} / n ELSE 0 END, 6) AS recall_{k}" for k in (5, 10, 100))
    + " FROM (SELECT topic, run_name, " + ", ".join(f"count(*) FILTER (rn <= {k} AND grade > 0) AS h{k}" for k in (5, 10, 100)) + " FROM j GROUP BY ALL) LEFT JOIN (SELECT topic, count(*) FILTER (grade > 0) AS n FROM q GROUP BY topic) USING (topic)",
    "eval_ap": f"WITH {_J}, {_AP} SELECT topic, run_name, round(ap, 6) AS ap FROM ap",
    "eval_dcg_ndcg": f"WITH {_J}, {_ND} SELECT topic, run_name, " + ", ".join(f"round(d{k}, 6) AS dcg_{k}, round(CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 0 END, 6) AS ndcg_{k}" for k in (10, 100, 0)) + " FROM g LEFT JOIN ideal USING (topic)",
    "eval_wss_nnr": f"WITH {_J}, {_counts()}, {_PR} SELECT topic, run_name, round(({SIZE} - num_ret) / {SIZE} - (1 - rc), 6) AS wss, round((num_ret + 1) / (num_rel_ret + 1), 6) AS nnr FROM pr",
    "eval_residual": f"WITH {_J}, {_TOPIC}, {_PER}, x AS (SELECT topic, run_name, num_ret, hit + un AS num_rel_ret, coalesce(rel, 0) + un AS num_rel FROM u LEFT JOIN t USING (topic)) {_SHARED}",
    "eval_mle": f"""WITH {_J}, {_TOPIC}, {_PER}, x AS (SELECT topic, run_name, num_ret, hit + m AS num_rel_ret, coalesce(rel, 0) + m AS num_rel
FROM (SELECT *, CAST(least(un, floor((coalesce(rel, 0) + 1) / (coalesce(nonrel, 0) + 1))) AS BIGINT) AS m FROM u LEFT JOIN t USING (topic))) {_SHARED}""",
    "eval_summary": f"""WITH {_J}, {_counts()}, {_PR}, {_AP}, {_ND}, v AS (
SELECT topic, run_name, 'precision' AS name, p AS value FROM pr UNION ALL SELECT topic, run_name, 'recall', rc FROM pr
UNION ALL SELECT topic, run_name, 'f1', CASE WHEN p > 0 AND rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END FROM pr UNION ALL SELECT topic, run_name, 'num_rel_ret', num_rel_ret FROM pr
UNION ALL SELECT topic, run_name, 'p@10', count(*) FILTER (rn <= 10 AND grade > 0) / 10 FROM j GROUP BY ALL
UNION ALL SELECT topic, run_name, 'ndcg@10', CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END FROM g LEFT JOIN ideal USING (topic)
UNION ALL SELECT topic, run_name, 'ap', ap FROM ap) SELECT run_name, name, round(avg(value), 6) AS mean, count(DISTINCT topic) AS topics FROM v GROUP BY ALL""",
    "eval_wide": f"WITH {_J}, {_counts()}, {_PR} SELECT concat_ws('/', coalesce(run_name, '-'), topic) AS list, round(p, 6) AS precision, round(rc, 6) AS recall FROM pr",
    "eval_all_measures": _every_measure(),
    "dedup_title": f"""WITH {CUR} SELECT 'all' AS topic, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(ti)) ORDER BY doc_id) AS k FROM cur) WHERE k = 1 OR ti IS NULL OR trim(ti) = ''""",
}
