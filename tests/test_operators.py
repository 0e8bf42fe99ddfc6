"""Operators against brute force and their laws; the judgements and run of the classic example by hand."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.catalog import formulation as fm
from ferrule.operators import evaluate as ev
from ferrule.operators import formulation as fo
from ferrule.operators import fusion as fu
from ferrule.operators import index as ix
from ferrule.operators import learning as le
from ferrule.operators import predictors as pr
from ferrule.operators import sampling as sa
from ferrule.operators import scorers as sc
from ferrule.operators import structure as st
from ferrule.plans import boolean as bl
from ferrule.plans.ast import Boolean, Keyword, to_json
from ferrule.plans.parsers import parse_expression, parse_medline


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = "heart failure stroke asthma trial dose cardiac cardiology women men".split()
    data = [(i, " ".join(rng.choices(words, k=4)), ". ".join(" ".join(rng.choices(words, k=5)) for _ in range(3)), rng.sample(["Sepsis", "Humans", " Aged "], 2), f"{2000 + i % 20}-03-01") for i in range(60)]
    data += [(60, None, None, None, None), (61, "", "", [], None), (62, "Heart!", "heart. HEART", [None, "Sepsis", "sepsis"], "2010-01-01")]
    return spark.createDataFrame(data, "doc_id long, ti string, ab string, mh array<string>, dcom string").withColumn("dcom", F.col("dcom").cast("date"))


QUERIES = {
    "a": parse_expression("heart.ti,ab. and stroke.ti."), "b": parse_expression("cardi$.ab. not women.ti."), "c": parse_expression("exp Sepsis/ and (asthma.ti. or trial.ab.)"),
    "d": parse_expression('"heart failure".ti. or nothing.ti.'), "e": Boolean("not", (Keyword("heart"),)), "f": parse_expression("(heart adj3 failure).ab."),
}


def test_both_boolean_plans_agree(spark, docs):
    postings = ix.index(docs)
    whole = rows(bl.matching(QUERIES, postings, docs))
    assert whole == rows(bl.matching_rows(QUERIES, docs)) and {t for t, _ in whole} == set(QUERIES)
    dated = {"x": Boolean("and", (Keyword("heart"), Keyword("2005/01:2012/12", ("publication_date",))))}
    assert rows(bl.matching(dated, postings, docs)) == rows(bl.matching_rows(dated, docs)) != []
    assert bl.matching({"z": Keyword("x", ("publication_type",))}, postings).count() == 0


def test_boolean_algebra(spark, docs):
    postings = ix.index(docs)
    ids = lambda q: {r.doc_id for r in bl.matching({"q": q}, postings).collect()}
    a, b = Keyword("heart"), Keyword("stroke")
    assert ids(Boolean("and", (a, b))) == ids(a) & ids(b) and ids(Boolean("or", (a, b))) == ids(a) | ids(b) and ids(Boolean("not", (a, b))) == ids(a) - ids(b)
    sizes = {r.node_id: (r.n, r.r) for r in bl.node_sizes({"q": Boolean("and", (a, b))}, postings, docs.where("doc_id < 10").select(F.lit("q").alias("topic"), "doc_id")).collect()}
    assert sizes[1] == (len(ids(a)), len({i for i in ids(a) if i < 10}))
    sets = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1), (1, 2)], "set_id int, doc_id long")
    assert rows(bl.set_combine("not", sets, [1, 2])) == [(1,)] and rows(bl.set_combine("and", sets, [])) == []


def test_index_statistics(spark, docs):
    p = {(r.term, r.field, r.doc_id): (r.tf, r.pos) for r in ix.index(docs).collect()}
    assert p["heart", "ti", 62] == (1.0, 2.0) and p["heart", "ab", 62] == (2.0, 2.0) and p["sepsis", "mh", 62] == (1.0, 1.0) and p["aged", "mh", next(i for t, f, i in p if t == "aged")] == (1.0, 1.0)
    assert not any(i in (60, 61) for _, _, i in p)
    assert ix.index(docs.limit(0)).count() == 0


def test_bm25_grows_with_tf_and_scorers_agree(spark):
    p = spark.createDataFrame([("x", "ti", 1, 1.0, 2.0), ("x", "ti", 2, 3.0, 1.5), ("y", "ti", 1, 2.0, 1.0), ("y", "ti", 3, 3.0, 1.0), ("z", "ti", 4, 3.0, 1.0)], "term string, field string, doc_id long, tf double, pos double")
    docs = spark.createDataFrame([(i, None) for i in range(1, 5)], "doc_id long, dcom date")
    c = sc.Collection(p, docs)
    terms = spark.createDataFrame([("t", "x"), ("t", "x")], "topic string, term string")
    got = {r.doc_id: r.score for r in sc.bm25(c, terms, ["ti"]).collect()}
    assert got[2] > got[1] > 0 and set(got) == {1, 2}
    every = {r.doc_id: r for r in sc.all_scores(c, terms.withColumn("field", F.lit("ti"))).collect()}
    for name in ("bm25", "ln_l2", "pos", "sum_tf", "sum_idf", "title_abstract", "doc_len", "pub_date"):
        assert {r.doc_id: round(r.score, 9) for r in sc.SCORERS[name](c, terms, ["ti"]).collect()} == {i: round(every[i][name], 9) for i in every}
    assert [r.doc_id for r in sc.rank(sc.bm25(c, terms, ["ti"]), "r", 1).collect()] == [2]
    assert {r.score for r in sc.vector_space(c, spark.createDataFrame([("t", "z")], "topic string, term string"), ["ti"]).collect()} == {1.0}


def test_classic_judgements_by_hand(spark):
    qrels = spark.createDataFrame([("1", i, g) for i, g in [(0, 1), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1)]], "topic string, doc_id long, grade long")
    run = ev.ranked(spark.createDataFrame([("1", "r", str(i), 10.0 - i) for i in range(2, 10)], "topic string, run_name string, doc_id string, score double"))
    at0 = ev.precision_recall(ev.counts(run, qrels, 0)).first()
    assert (at0.num_ret, at0.num_rel, at0.num_rel_ret, at0.precision) == (8, 5, 4, 0.5)
    mle = ev.precision_recall(ev.mle_counts(run, qrels, 0)).first()
    assert (mle.num_rel_ret, mle.precision) == (6, 0.75)
    assert ev.precision_recall(ev.counts(run, qrels, 1)).first().precision == 0.0
    assert ev.precision_recall(ev.mle_counts(run, qrels, 1)).first().precision == 0.0
    assert ev.precision_recall(ev.residual_counts(run, qrels, 0)).first().recall >= at0.recall


def test_ideal_run_is_perfect(spark):
    qrels = spark.createDataFrame([("1", i, 3 - i) for i in range(3)], "topic string, doc_id long, grade int")
    run = ev.ranked(spark.createDataFrame([("1", "r", str(i), 5.0 - i) for i in range(2)] + [("1", "r", "0", None), (None, "r", "1", 1.0), ("1", "r", "1", 0.1)], "topic string, run_name string, doc_id string, score double"))
    assert round(ev.dcg(run, qrels, [2]).first()["ndcg_2"], 9) == 1.0
    assert round(ev.average_precision(run, qrels).first().ap, 9) == round(2 / 3, 9)
    compat = ev.precision_recall(ev.counts(run, qrels), compat=True).first()
    assert compat.precision == 0.0 and ev.precision_recall(ev.counts(run, qrels)).first().precision == 1.0
    names = ev.registry(100)
    assert len(names) >= 31
    long = ev.evaluate(run, qrels, {n: names[n] for n in ("p@10", "recall", "wss", "nnr")})
    assert {r["name"]: round(r["value"], 6) for r in long.collect()} == {"p@10": 0.2, "recall": round(2 / 3, 6), "wss": round(98 / 100 - 1 / 3, 6), "nnr": 1.0}
    assert ev.summary(long).count() == 4


def test_no_judgements_and_empty_runs(spark):
    run = ev.ranked(spark.createDataFrame([("1", "r", "5", 1.0)], "topic string, run_name string, doc_id string, score double"))
    none = spark.createDataFrame([], "topic string, doc_id long, grade int")
    assert ev.precision_recall(ev.counts(run, none)).first().recall == 0.0 and ev.average_precision(run, none).first().ap == 0.0 and ev.dcg(run, none, [5]).first()["ndcg_5"] == 0.0
    assert ev.counts(run.limit(0), none).count() == 0


def test_fusion(spark):
    lists = spark.createDataFrame([("t", "a", 1, 10.0), ("t", "a", 2, 0.0), ("t", "b", 1, 5.0), ("t", "b", 3, 5.0)], "topic string, list_id string, doc_id long, score double")
    scaled = {(r.list_id, r.doc_id): r.score for r in fu.min_max(lists).collect()}
    assert scaled == {("a", 1): 1.0, ("a", 2): 0.0, ("b", 1): 0.0, ("b", 3): 0.0}
    assert {r.doc_id: r.score for r in fu.comb_mnz(lists).collect()} == {1: 30.0, 2: 0.0, 3: 5.0}
    cut = spark.createDataFrame([("t", i, s) for i, s in enumerate([5.0, 3.0, 1.0, 1.0])] + [("u", 1, 0.0)], "topic string, doc_id long, score double")
    assert rows(fu.gain_cut(cut, 0.6).select("topic", "doc_id")) == [("t", 0), ("t", 1)]
    made = spark.createDataFrame([("t", f"q{i}", i) for i in range(9)], "topic string, query string, retrieved long")
    assert fu.variations(made, 8, 1, 5).count() == 5


def test_predictors_after_retrieval(spark):
    run = spark.createDataFrame([("t", "r", i, 4.0 - i, i + 1) for i in range(4)], "topic string, run_name string, doc_id long, score double, rn int")
    q = spark.createDataFrame([("t", 4.0)], "topic string, query_length double")
    assert pr.wig(run, q, 2).first().wig == pytest.approx(1.25) and pr.wig(run, q, 2, compat=True).first().wig == pytest.approx(1.5)
    assert pr.weg(run, q, 2).first().weg == pytest.approx((2.5 + 1.5) / 2 / 2) and pr.nqc(run, 2).first().nqc == pytest.approx(0.5)


def test_structure(spark):
    q = parse_medline("1. exp Sepsis/\n2. (heart adj2 failure).ti,ab.\n3. trial$.ti.\n4. (1 or 2) and 3")
    n = st.nodes(spark.createDataFrame([("t", to_json(q)), ("bad", "{"), (None, None)], "topic string, query string"))
    c = st.counts(n).first()
    assert (c.keywords, c.boolean_nodes, c.and_clauses, c.or_clauses, c.adj_clauses, c.truncated, c.mesh_exploded, c.terms, c.fields) == (4, 3, 2, 1, 1, 1, 1, 4, 6)
    assert st.counts(n, compat=True).first().boolean_nodes == 5
    assert st.complexity(n).first().complexity == pytest.approx(2 / 4 / 2 * 6)
    mesh = spark.createDataFrame([("Sepsis", "C01.757"), ("Sepsis", "C23.550.470")], "heading string, tree_number string")
    assert st.mesh_depths(n, mesh).first().max_depth == 2
    protocols = spark.createDataFrame([("t", "Heart trials", None)], "topic string, objective string, participants string")
    assert tuple(st.string_reachability(n, protocols, ["objective", "participants"]).first()) == ("t", 4, 2, 0)
    r = st.explosion_ratio(st.counts(n)).first()
    assert r.ratio == 1.0 and r.addition.a == 0.0


@pytest.fixture(scope="module")
def candidates(spark):
    rng = random.Random(3)
    return spark.createDataFrame([("t", i, i % 3, rng.random(), {1: float(i), 2: float(i % 4)}, i % 5) for i in range(30)] + [("u", 1, 1, 0.5, {}, 1), ("u", 2, 1, 0.5, None, 1)], "topic string, candidate_id long, transformation_id int, score double, features map<int,double>, retrieved int")


def test_samplers(spark, candidates):
    b = rows(sa.balanced(candidates, 0.0, 7).where("topic = 't'").groupBy("transformation_id").count())
    assert b == [(0, 3), (1, 2), (2, 2)]
    assert sa.stratified(candidates, 0.1, 3).where("topic = 't'").count() == 6 and sa.random(candidates, 0.1, 3, 1).where("topic = 't'").count() == 6
    assert rows(sa.random(candidates.repartition(5), 0.1, 3, 1)) == rows(sa.random(candidates, 0.1, 3, 1))
    assert sa.balanced_scored(candidates, 10).where("topic = 't'").count() == 10
    base = spark.createDataFrame([("t", 0.5)], "topic string, baseline double")
    assert all(r.score >= 0.5 for r in sa.against_baseline(candidates, base, 3, "positive").collect()) and all(r.score < 0.5 for r in sa.against_baseline(candidates, base, 3, "negative").collect())
    assert sa.greedy(candidates, 2).where("topic = 't'").agg(F.max("retrieved")).first()[0] == 0
    mmr = sa.maximal_marginal_relevance(candidates, 3, 1.0).where("topic = 't'").orderBy("pick").collect()
    assert [m.score for m in mmr] == sorted((r.score for r in candidates.where("topic = 't'").collect()), reverse=True)[:3]
    assert sa.clustered(candidates, 4).groupBy("topic").count().where("topic = 't'").first()["count"] == 4


def test_selectors(spark, candidates):
    assert le.best_of(candidates).where("topic = 'u'").first().candidate_id == 1
    c = candidates.where("features IS NOT NULL")
    near = le.nearest_selector(c, le.train_nearest(c))
    assert near.count() <= 1
    model = le.train_ranker(candidates.na.fill({"score": 0.0}))
    assert le.select_by(model, candidates).count() == 2
    judged = candidates.withColumn("rel_ret", F.col("retrieved")).withColumn("ret", F.col("candidate_id"))
    now = spark.createDataFrame([("t", 4, 20), ("u", 9, 9)], "topic string, cur_rel_ret int, cur_ret int")
    assert rows(le.oracle(judged, now).select("topic", "candidate_id")) == [("t", 4)]


def nearest_by_all_pairs(c):
    order = Window.partitionBy("topic").orderBy(F.round("cosine", 9).desc(), "candidate_id", "model_topic")
    pairs = le.cosines(c, le.train_nearest(c)).where("topic <> model_topic")
    return pairs.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")


def candidate_vectors(spark, topics, each, features, values, sizes, seed):
    r = random.Random(seed)
    made = [(f"t{t:04}", i, r.random(), {f: r.choice(values) if isinstance(values, list) else values(r) for f in r.sample(range(features), r.choice(sizes))}) for t in range(topics) for i in range(each)]
    return spark.createDataFrame(made, "topic string, candidate_id long, score double, features map<int,double>").repartition(4).localCheckpoint()


@pytest.mark.parametrize(("topics", "features", "values", "sizes", "entries"), [
    (60, 12, lambda r: r.lognormvariate(0, 1), [2, 3, 5, 8], 500_000),
    (60, 12, lambda r: r.lognormvariate(0, 1), [2, 3, 5, 8], 100),
    (40, 5, [1.0, 2.0, 0.0, None], [0, 1, 2, 3], 20),
    (40, 6, [1.0, -1.0, 3.0, 1e-9], [1, 2, 4], 500_000),
    (30, 400, lambda r: r.gauss(0, 1), [3, 10, 30], 500_000),
    (30, 30, [float("nan"), float("inf"), *[float(n) for n in range(1, 30)]], [1, 2, 4], 20),
])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, topics, features, values, sizes, entries):
    monkeypatch.setattr(le, "PASS_ENTRIES", entries)
    c = candidate_vectors(spark, topics, 5, features, values, sizes, 3)
    got, wanted = ({r.topic: (r.candidate_id, r.model_topic, f"{r.cosine:.9f}") for r in d.collect()} for d in (le.nearest_selector(c, le.train_nearest(c)), nearest_by_all_pairs(c)))
    assert got == wanted and got


def test_nearest_stores_no_pairs(spark):
    """400 topics of which all candidates share a feature with all models: 800,000 pairs, of which no stage may write more than a fraction."""
    c = candidate_vectors(spark, 400, 5, 8, lambda r: r.lognormvariate(0, 1), [5, 6], 4)
    store, sc = spark.sparkContext._jsc.sc(), spark.sparkContext

    def stages():
        store.listenerBus().waitUntilEmpty(30_000)
        found = store.statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    for conf in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):  # as with tables too large to broadcast
        spark.conf.set(conf, "-1")
    try:
        assert le.nearest_selector(c, le.train_nearest(c)).count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert max(n for i, n in stages().items() if i not in before) < 20_000


def test_explorers():
    start = le.Candidate(parse_expression("(a.ti. and b.ti,ab.) or c.ab."), -1)
    wide = le.breadth_first(start, lambda level: level[:5], 2)
    assert len({str(c.query) for c in wide}) == len(wide) == 10 and max(c.depth for c in wide) == 2
    deep = le.depth_first(start, le.balanced_transformations(), 12)
    assert 0 < len(deep) <= 12 and max(len(c.chain) for c in deep) <= 5
    assert le.run_chain(start, lambda now, options: None) == [start]
    assert len(le.run_chain(start, lambda now, options: options[0], 3)) == 4


def test_formulation(spark):
    labels = spark.createDataFrame([(i, i < 10) for i in range(20)], "doc_id long, label boolean")
    terms = spark.createDataFrame([(i, "good") for i in range(10)] + [(i, "all") for i in range(20)] + [(i, "some") for i in range(5, 15)], "doc_id long, term string")
    gain = {r.term: r.gain for r in fo.information_gain(terms, labels).collect()}
    assert gain["good"] == pytest.approx(1.0) and gain["all"] == pytest.approx(0.0) and gain["some"] == pytest.approx(0.0)
    assert str(fo.tree_query(fo.id3(terms, labels))) == "good[title,abstract]"
    parts = fo.split(labels.select(F.lit("t").alias("topic"), "doc_id"))
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"dev": 10, "val": 5, "unseen": 5}
    cover = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "y", 2), ("b", "z", 1), ("b", "z", 2), ("b", "w", 9)], "category string, term string, doc_id long")
    assert rows(fo.unique_coverage(cover)) == [("a", "x", 0), ("a", "y", 1), ("b", "w", 0), ("b", "z", 2)]
    assert str(fo.tree_to_query(fo.parse_tree("(NP (NP (JJ deep) (NN vein)) (CC or) (NP (NN stroke)))"))) == "(deep vein[title,abstract] or stroke[title,abstract])"
    assert str(fo.compose_by_similarity([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])])) == "((a[title,abstract] or b[title,abstract]) and c[title,abstract])"


@pytest.mark.parametrize("local_rows", [0, 60, 10_000])
def test_id3_grows_to_pure_leaves(spark, local_rows):
    """A label by the first of six terms that a document lacks: every leaf is pure, however the nodes are grown."""
    held = {i: {f"t{b}" for b in range(6) if i >> b & 1} for i in range(64)}
    label = {i: next((b for b in range(6) if f"t{b}" not in held[i]), 6) % 2 == 1 for i in held}
    terms = spark.createDataFrame([(i, t) for i, ts in held.items() for t in ts], "doc_id long, term string")
    tree = fo.id3(terms, spark.createDataFrame(list(label.items()), "doc_id long, label boolean"), local_rows=local_rows)
    for i in held:
        node = tree
        while node.term:
            node = node.present if node.term in held[i] else node.absent
        assert node.label == label[i]
    depth = lambda t: 1 + max(depth(t.present), depth(t.absent)) if t.term else 0
    assert depth(tree) > 4


def test_objective_formulator_keeps_all_terms_and_adds_headings(spark):
    """30 terms of equal frequency of which only the last find validation documents, and a heading (the 12th) that finds one more."""
    judged = spark.createDataFrame([("t", i) for i in range(16)], "topic string, doc_id long")
    part = {r.doc_id: r.part for r in fo.split(judged).collect()}
    dev, val = ([i for i in part if part[i] == p] for p in ("dev", "val"))
    words, headings = [f"w{j:02}" for j in range(30)], [f"h{j:02}" for j in range(18)]
    held = {i: [("ti", w) for w in words] + [("mh", h) for h in headings] for i in dev}
    held |= {i: [("ab", w) for w in words[25:]] for i in val[:-1]} | {val[-1]: [("mh", headings[11])]}
    docs = spark.createDataFrame([(i, [h for f, h in held.get(i, []) if f == "mh"]) for i in range(1000)], "doc_id long, mh array<string>")
    postings = spark.createDataFrame([(t, f, i) for i, ts in held.items() for f, t in ts], "term string, field string, doc_id long")
    terms = postings.where("field <> 'mh'").select("doc_id", "term")
    formulator = fo.ObjectiveFormulator()
    of_terms, of_both = formulator.formulate(spark, judged, docs, terms, postings)
    assert [k.text for k in of_terms.children] == words
    assert [k.text for k in of_both.children] == words + headings[:15]
    assert [name for name, _ in formulator.trace if "mesh" in name] == ["mesh 1", "mesh 5", "mesh 10", "mesh 15", "mesh 20"]


def test_objective_query_has_every_heading(spark, tmp_path):
    medline = [(i, "t", "", [fm.HEADINGS[i % 3]] if i < 24 else [], None, None) for i in range(1200)]
    spark.createDataFrame(medline, "pmid long, ti string, ab string, mh array<string>, dcom string, loaded_at timestamp").write.parquet(f"{tmp_path}/medline.parquet")
    postings = [(t, f, i, 1.0, 1.0) for i in range(24) for t, f in ((f"word{i % 3}", "ti"), (fm.HEADINGS[i % 3], "mh"))]
    spark.createDataFrame(postings, "term string, field string, pmid long, tf double, pos double").write.parquet(f"{tmp_path}/postings.parquet")
    got = fm.objective_query(spark, str(tmp_path))
    assert rows(got) == rows(spark.createDataFrame([(fm.HEADINGS[i % 3], i, how) for i in range(24) for how in ("terms", "headings")]))


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0], i % 2) for i in range(40)] + [(99, None, 0), (98, [], 0), (97, [0.0, 0.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    import math

    raw = {r.vec_id: r.embedding for r in v.collect() if r.embedding}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b)) if any(a) and any(b) else 0.0
    got = fo.nearest_vectors(v.where("vec_id % 20 = 0"), v, 4, block=1)
    for q in (0, 20):
        want = sorted(((-round(cos(raw[q], e), 9), i) for i, e in raw.items() if i != q))[:4]
        assert [(r.similarity, r.vec_id) for r in got.where(F.col("query_id") == q).orderBy(F.col("similarity").desc(), "vec_id").collect()] == [(-s, i) for s, i in want]
    assert len(fo.centroids(v, "label").where("label = 1").first().centroid) == 3


def test_titles_once(spark, docs):
    run = docs.select(F.lit("t").alias("topic"), F.lit("r").alias("run_name"), "doc_id", F.lit(1.0).alias("score"), F.col("doc_id").alias("rn"))
    twice = run.unionByName(run.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("rn", F.col("rn") + 1000))
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    kept = ev.deduplicate_titles(twice, more)
    assert kept.where("doc_id IN (1060, 1061)").count() == 2 and kept.where("doc_id = 1062").count() == 0


def test_fusion_plan_does_not_double_with_depth(spark):
    from ferrule.plans.ast import ABSTRACT, TITLE, Boolean, Keyword

    postings = spark.createDataFrame([(w, f, i, float(1 + (i + j) % 3), 1.0) for i in range(12) for j, w in enumerate("abcdefg") for f in ("ti", "ab") if (i * 7 + j) % 3], "term string, field string, doc_id long, tf double, pos double")
    docs = postings.select("doc_id").distinct().withColumn("dcom", F.lit(None).cast("date"))

    def chain(depth):
        node = Keyword("a", (TITLE, ABSTRACT))
        for i in range(depth):
            node = Boolean("and" if i % 2 else "or", (node, Keyword("bcdefg"[i], (TITLE, ABSTRACT))))
        return node

    def brute(node, leaf):
        if isinstance(node, Keyword):
            return leaf[node.text]
        lists = [brute(c, leaf) for c in node.children]
        out = {}
        for d in set().union(*lists):
            there = [x[d] for x in lists if d in x]
            out[d] = sum(there) * (1 if node.operator == "and" else sum(v > 0 for v in there))
        return out

    scorers = ("bm25", "pos")
    leaf = {w: {} for w in "abcdefg"}
    for r in fu.fuse_tree({w: Keyword(w, (TITLE, ABSTRACT)) for w in leaf}, sc.Collection(postings, docs), scorers).collect():
        leaf[r.topic][r.doc_id] = r.score
    exchanges = set()
    for depth in (1, 3, 6):
        df = fu.fuse_tree({"t": chain(depth)}, sc.Collection(postings, docs), scorers)
        assert {r.doc_id: round(r.score, 6) for r in df.collect()} == {d: round(v, 6) for d, v in brute(chain(depth), leaf).items()}
        plan = df._jdf.queryExecution().sparkPlan().toString()
        exchanges.add((plan.count("Scan parquet"), plan.count("Join") - depth))
    assert len(exchanges) == 1


def test_saved_collection_scores_alike(spark, tmp_path):
    from ferrule.operators import index as ix

    postings = spark.createDataFrame([(w, f, i, float(1 + (i + j) % 4), 1.0 + j / 10) for i in range(30) for j, w in enumerate(["x", "y", "z"]) for f in ("ti", "ab", "mh") if (i + j) % 4], "term string, field string, doc_id long, tf double, pos double")
    docs = postings.select("doc_id").distinct().withColumn("dcom", F.lit("2020-01-02").cast("date"))
    terms = spark.createDataFrame([("q", "x"), ("q", "unseen"), ("r", "y"), ("r", "z")], "topic string, term string")
    ix.save_index(postings, f"{tmp_path}/index")
    for name, scorer in sc.SCORERS.items():
        plain, saved = (sorted((r.topic, r.doc_id, round(r.score, 9)) for r in scorer(c, terms, ["ti", "ab"]).collect()) for c in (sc.Collection(postings, docs), sc.Collection.saved(spark, f"{tmp_path}/index", docs)))
        assert plain == saved and plain, name
    ix.save_index(postings.limit(0), f"{tmp_path}/none")
    assert sc.bm25(sc.Collection.saved(spark, f"{tmp_path}/none"), terms, ["ti"]).count() == 0


def test_residual_and_likelihood_of_ranked_measures(spark):
    """Against scores computed from judgements that are extended first."""
    import math
    import random

    rng = random.Random(3)
    run = {t: rng.sample(range(40), 25) for t in "ab"}
    qrels = {"a": {d: rng.choice([0, 0, 1, 2, 3]) for d in range(20)}, "b": {d: rng.choice([0, 1, 1]) for d in range(12)}}
    long = spark.createDataFrame([(t, "r", d, 1.0, i + 1) for t, ds in run.items() for i, d in enumerate(ds)], "topic string, run_name string, doc_id long, score double, rn long")
    judged = spark.createDataFrame([(t, d, g) for t, q in qrels.items() for d, g in q.items()], "topic string, doc_id long, grade int")
    known, names = ev.registry(100), ("ap", "p@10", "recall@100", "precision", "nnr", "ndcg@5", "ndcg@100")
    got = {(r.topic, r.name): r.value for r in ev.evaluate(long, judged, {n + v: known[n + v] for n in names for v in ev.VARIANTS}).collect()}
    for t, ds in run.items():
        likely = (sum(g > 0 for g in qrels[t].values()) + 1) // (sum(g <= 0 for g in qrels[t].values()) + 1)
        new = [d for d in ds if d not in qrels[t]]
        for v, added in (("", []), ("_res", new), ("_mle", new[:likely])):
            q = qrels[t] | {d: 1 for d in added}
            rel = sum(g > 0 for g in q.values())
            hits = [q.get(d, 0) > 0 for d in ds]
            dcg = lambda gs, k: sum(g / math.log2(i + 2) for i, g in enumerate(gs[:k]))
            want = {
                "ap": sum(sum(hits[: i + 1]) / (i + 1) for i, h in enumerate(hits) if h) / rel, "p@10": sum(hits[:10]) / 10, "recall@100": sum(hits) / rel, "precision": sum(hits) / len(ds), "nnr": (len(ds) + 1) / (sum(hits) + 1),
                "ndcg@5": dcg([q.get(d, 0) for d in ds], 5) / dcg(sorted(q.values(), reverse=True), 5), "ndcg@100": dcg([q.get(d, 0) for d in ds], 100) / dcg(sorted(q.values(), reverse=True), 100),
            }
            for name, value in want.items():
                assert abs(got[t, name + v] - value) < 1e-9, (t, name + v)


def test_categories_are_joined_by_and(spark):
    """Conditions and treatments from semantic types; a term of another type is dropped, and so are two terms of a category that reach the same documents."""
    judged = spark.createDataFrame([("t", i) for i in range(16)], "topic string, doc_id long")
    part = {r.doc_id: r.part for r in fo.split(judged).collect()}
    held = [("flu", i) for i in part] + [("drug", i) for i in part] + [("pill", i) for i in part if part[i] == "dev"] + [("study", i) for i in part] + [("flu", i) for i in range(100, 110)]
    docs = spark.createDataFrame([(i, ["head"] if i in part else []) for i in range(2000)], "doc_id long, mh array<string>")
    postings = spark.createDataFrame([(t, "ti", i) for t, i in held], "term string, field string, doc_id long")
    types = spark.createDataFrame([("flu", "dsyn"), ("drug", "phsu"), ("pill", "phsu"), ("study", "zzzz")], "term string, semantic_type string")
    terms = postings.select("doc_id", "term")
    found, _ = fo.ObjectiveFormulator(pop_cuts=(0.02,)).choose(spark, judged, docs, terms, postings, types)
    assert {c: [k.text for k in ks] for c, ks in found.items()} == {"condition": ["flu"]}
    two = {"q": {"condition": found["condition"], "treatment": [fo.Keyword("drug")]}}
    assert {r.doc_id for r in fo.category_hits(two, postings).collect()} == set(part)
    measured = {(r.part, r.name): r.value for r in fo.objective_measures(fo.split(judged), two, postings).collect()}
    assert measured["dev", "recall"] == measured["unseen", "recall"] == 1.0 and measured["val", "num_ret"] == 16 and len(measured) == 27


def test_filters_and_suffixes_are_whole():
    from ferrule.functions import text as tx
    from ferrule.plans import rewrites as rw
    from ferrule.plans.parsers import parse_expression

    assert len(tx.NOUN_SUFFIXES + tx.VERB_SUFFIXES + tx.ADJECTIVE_SUFFIXES) == 53
    q = parse_expression("(a.ti,ab. or b.ti,ab.)")
    assert str(rw.rct_filter(q)).startswith("((a[title,abstract] or b[title,abstract]) and (Randomized Controlled Trials As Topic+[mesh_headings] or ")
    assert "drug therapy[mesh_floating]" in str(rw.sensitivity_filter(q)) and "clinical trials as topic[mesh_headings]" in str(rw.precision_sensitivity_filter(q))


def test_untitled_documents_stay(spark):
    docs = spark.createDataFrame([(1, "A"), (2, " a"), (3, None), (4, ""), (5, None), (6, "b")], "doc_id long, ti string")
    run = spark.createDataFrame([("t", "r", i, 0.0, i) for i in range(1, 8)], "topic string, run_name string, doc_id long, score double, rn long")
    assert sorted(r.doc_id for r in ev.deduplicate_titles(run, docs).collect()) == [1, 3, 4, 5, 6, 7]


def test_generate_train_validate_and_run_a_chain(spark):
    """A query that gains by leaving out its second clause: the model learns it from one topic and applies it to another."""
    from ferrule.plans.variations import Candidate

    postings = spark.createDataFrame([(t, "ti", 100 * k + i) for k in range(2) for i in range(20) for t in ([f"good{k}"] if i < 10 else []) + ([f"rare{k}"] if i == 0 else [])], "term string, field string, doc_id long")
    judged = spark.createDataFrame([(f"t{k}", 100 * k + i) for k in range(2) for i in range(10)], "topic string, doc_id long")
    starts = {f"t{k}": Candidate(parse_expression(f"good{k}.ti. and rare{k}.ti."), -1) for k in range(2)}
    made = le.generate(starts, postings, judged)
    scores = {(r.topic, r.query): round(r.score, 6) for r in made.collect()}
    assert scores["t0", "(good0[title] or rare0[title])"] == 1.0 and scores["t0", "(good0[title])"] == 1.0 and scores["t0", "(rare0[title])"] == round(2 / 11, 6)
    model = le.train_ranker(made.where("topic = 't0'"))
    assert {(r.topic, r.best) for r in le.validate(model, made).collect()} == {("t0", 1.0), ("t1", 1.0)}
    chain = le.run_chain(starts["t1"], le.model_choice(spark, model), 2)
    assert len(chain) >= 2 and chain[1] in [c for c in le.breadth_first(starts["t1"], lambda level: level, 1)]


def test_term_filter_keeps_wanted_words(spark):
    docs = spark.createDataFrame([(1, "Heart failure of hearts", "The heart.", ["Heart"])], "doc_id long, ti string, ab string, mh array<string>")
    assert {(r.term, r.field) for r in ix.index(docs, lambda t: t.startswith("heart")).collect()} == {("heart", "ti"), ("hearts", "ti"), ("heart", "ab"), ("heart", "mh")}
