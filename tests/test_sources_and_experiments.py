import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ferrule.catalog import streams
from ferrule.operators import index as ix
from ferrule.operators import scorers as sc
from ferrule.pipeline import Experiment, evaluation_report, load_experiment
from ferrule.plans.ast import Keyword
from ferrule.plans.parsers import parse_expression
from ferrule.sources import readers as rd
from ferrule.sources import writers as wr
from ferrule.streaming import facade as sf


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_run_and_qrels_files(spark, tmp_path):
    run = spark.createDataFrame([("1", None, "7", 1, 0.5, "r"), ("1", "Q1", "8", 2, 0.25, "r")], "topic string, iteration string, doc_id string, rank long, score double, run_name string")
    wr.write_run(run, f"{tmp_path}/run")
    assert rows(rd.read_run(spark, f"{tmp_path}/run")) == [("1", "Q0", "7", 1, 0.5, "r"), ("1", "Q1", "8", 2, 0.25, "r")]
    q = rd.read_qrels(spark, put(tmp_path / "q/a", "1 0 7 1\n\n2\t0  9 0\nbroken\n"))
    assert rows(q) == [("1", "0", "7", 1), ("2", "0", "9", 0), ("broken", None, None, None)]
    assert rd.qrels_of(q, "2").count() == 1


def test_feature_files(spark, tmp_path):
    df = spark.createDataFrame([("t", 0.5, {10: 2.0, 2: 1.5}, "c", [0.1, None])], "topic string, score double, features map<int,double>, comment string, scores array<double>")
    assert wr.libsvm_lines(df).first().value == "0.5 2:1.5 10:2.0"
    wr.write_lines(wr.libsvm_rank_lines(df), f"{tmp_path}/f")
    assert [tuple(r) for r in rd.read_libsvm_rank(spark, f"{tmp_path}/f").collect()] == [("t", 0.5, {2: 1.5, 10: 2.0}, "c")]
    wr.write_lines(wr.reinforcement_lines(df), f"{tmp_path}/r")
    assert [tuple(r) for r in rd.read_reinforcement(spark, f"{tmp_path}/r").collect()] == [("t", [0.1, 0.0], {2: 1.5, 10: 2.0}, "c")]


def test_small_files(spark, tmp_path):
    assert rows(rd.read_pmids(spark, put(tmp_path / "p/x", "12\n x\n 13 \n\n"))) == [(12,), (13,)]
    put(tmp_path / "k/one", "heart\n")
    put(tmp_path / "k/two", "stroke")
    assert rows(rd.read_keyword_queries(spark, f"{tmp_path}/k", ("title",))) == [("one", "heart", ["title"]), ("two", "stroke", ["title"])]
    assert rows(rd.read_semantic_types(spark, put(tmp_path / "s/x", 'aapp|x"y|z|prot\n'))) == [("aapp", "prot")]
    d = rd.read_date_restrictions(spark, put(tmp_path / "d/x", "7\t20010203\t20020304\n8\tbad\t\n"))
    assert [(r.topic, str(r.start), str(r.end)) for r in d.orderBy("topic").collect()] == [("7", "2001-02-03", "2002-03-04"), ("8", "None", "None")]
    put(tmp_path / "x/T1.xml", "<root><objective>Find it</objective><participants>All</participants></root>")
    assert [(r.topic, r.objective, r.index_tests) for r in rd.read_protocols(spark, f"{tmp_path}/x").collect()] == [("T1", "Find it", None)]
    script = rd.parse_extraction_script('{"pmids": [1, 2], "field": "title", "statistic": {"key": "k"}}')
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, ti string")
    assert rows(rd.extract(docs, script)) == [(1, "a"), (2, "b")]
    assert json.loads(wr.titles_json(rd.extract(docs, script)).orderBy("value").first().value) == {"doc_id": 1, "value": "a"}


def test_query_files(spark, tmp_path):
    put(tmp_path / "q/good", "1. heart.ti.\n2. stroke.ti.\n3. 1 or 2")
    put(tmp_path / "q/bad", "(heart")
    got = {r.topic: (r["query"] is not None, r.error is not None) for r in rd.read_queries(spark, f"{tmp_path}/q").collect()}
    assert got == {"good": (True, False), "bad": (False, True)}
    topic = rd.parse_tar_topic("Topic: CD1\n\nTitle: Some title\n\nQuery:\n1. exp Aged/\n2. “heart attack”.tw.\n3. 1 and 2\n\nPids:\n 1\n 2\n")
    assert topic.topic == "CD1" and topic.title == "Some title" and len(topic.query.children) == 2
    assert str(rd.simplify_original(topic.query)) == "(heart attack[title,abstract])"
    assert rd.parse_tar_topic("Topic: X\nTitle: t\nQuery: a[tiab] AND b[mh]\n").query.operator == "and"


@pytest.fixture(scope="module")
def collection(spark):
    docs = spark.createDataFrame([(1, "heart attack", "heart and stroke. more", ["Sepsis"], None), (2, "stroke care", "women", [], None), (3, "dose", "heart", None, None)], "doc_id long, ti string, ab string, mh array<string>, dcom date")
    return sc.Collection(ix.index(docs), docs)


def test_experiment_end_to_end(spark, collection, tmp_path):
    qrels = spark.createDataFrame([("q1", 1, 1), ("q1", 2, 0), ("q2", 3, 1)], "topic string, doc_id long, grade int")
    queries = {"q1": parse_expression("heart.ti. or stroke.ti."), "q2": Keyword("heart")}
    e = Experiment(queries, ("flatten",), measurements=("keywords", "terms"), evaluations=("precision", "recall"), outputs=(("measurements.csv", f"{tmp_path}/m"), ("run.trec", f"{tmp_path}/run"), ("evaluation.json", f"{tmp_path}/e"), ("measurements.json", f"{tmp_path}/j")))
    out = e.run(spark, collection, qrels, 3)
    assert {(r.topic, r["name"]): r["value"] for r in out["evaluation"].collect()} == {("q1", "precision"): 0.5, ("q1", "recall"): 1.0, ("q2", "precision"): 0.5, ("q2", "recall"): 1.0}
    assert rd.read_run(spark, f"{tmp_path}/run").count() == 4 and spark.read.option("header", True).csv(f"{tmp_path}/m").count() == 2 and spark.read.json(f"{tmp_path}/e").count() == 2
    for how in ("bm25", "fusion"):
        assert Experiment(queries, retrieval=how).executed(collection).where("rank = 1").count() == 2
    prefixed = out["run"].withColumn("topic", F.concat(F.lit("2019_"), "topic"))
    assert evaluation_report(prefixed, qrels, ["recall"], 3, summarise=True).first().topics == 2


def test_experiment_description(spark, tmp_path):
    put(tmp_path / "q/t1", "heart.ti. and stroke.ti.")
    e = load_experiment(spark, json.dumps({"query": {"format": "medline", "path": f"{tmp_path}/q"}, "preprocess": ["all_or"], "measurements": ["keywords"], "output": {"measurements": [{"format": "json", "filename": f"{tmp_path}/o"}]}}))
    assert e.prepared["t1"].operator == "or" and e.outputs == (("measurements.json", f"{tmp_path}/o"),)
    assert rows(e.measured(spark)) == [("t1", "keywords", 2.0)]
    put(tmp_path / "q/t2", "(")
    with pytest.raises(ValueError, match="t2"):
        load_experiment(spark, json.dumps({"query": {"path": f"{tmp_path}/q"}}))


def test_stream_sessions_count_late_files(spark, tmp_path):
    """More files than two triggers read (the watermark of a batch holds from the second batch after it on), the oldest events in the last one."""
    for i in range(18):
        spark.createDataFrame([(i, datetime(2024, 1, 20 - i, h)) for h in (0, 1)], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.user_id, r.n) for r in streams.stream_sessions(spark, str(tmp_path)).collect()) == [(i, 2) for i in range(18)]


def test_streams(spark, collection, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts, id % 2 AS user_id, 'a' AS event_type, 1.5D AS value FROM range(6)")
    events.coalesce(1).write.parquet(f"{tmp_path}/ev")
    got = sf.run_to_table(sf.windowed_counts(sf.read_stream(spark, f"{tmp_path}/ev"), "ts", ["event_type"]), "complete")
    assert sorted(r.n for r in got.collect()) == [3, 3]
    assert sf.run_to_table(sf.sessions(sf.read_stream(spark, f"{tmp_path}/ev"), "ts", "user_id", "30 minutes"), "complete").count() == 6
    spark.createDataFrame([("q", "heart")], "topic string, term string").write.parquet(f"{tmp_path}/terms")
    hits = sf.run_to_table(sf.matched_stream(sf.read_stream(spark, f"{tmp_path}/terms"), collection, ["ti", "ab"]))
    assert {r.doc_id for r in hits.collect()} == {1, 3}
    query = sf.score_each_batch(sf.read_stream(spark, f"{tmp_path}/terms"), lambda b: sc.sum_tf(collection, b, ["ti", "ab"]), f"{tmp_path}/scored").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/scored").count() == 2


def test_imports_without_the_optional_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ferrule.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('p1_') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_topic_files_of_a_folder_are_parsed_once(spark, tmp_path):
    folder = tmp_path / "topics"
    folder.mkdir()
    (folder / "1").write_text("Topic: CD01\n\nTitle: First one\n\nQuery:\n1. exp Sepsis/\n2. fever.ti,ab.\n3. 1 or 2\n\nPids:\n  12\n")
    (folder / "2").write_text("Topic: CD02\n\nTitle: Broken\n\nQuery:\n1. (a.ti.\n2. 1 and\n3. or/1-\n")
    found = {r.topic: r for r in rd.read_tar_topics(spark, str(folder)).collect()}
    assert found["CD01"].title == "First one" and "Sepsis" in found["CD01"].query and "Sepsis" not in found["CD01"].simplified
    assert found[None].error and found[None].query is None
    wr.save_queries(rd.read_tar_topics(spark, str(folder)), f"{tmp_path}/saved")
    assert {r.topic for r in rd.load_queries(spark, f"{tmp_path}/saved").collect()} == {"CD01", None}
