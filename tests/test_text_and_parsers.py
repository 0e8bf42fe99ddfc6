import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.functions import text as tx
from ferrule.plans import rewrites as rw
from ferrule.plans import variations as va
from ferrule.plans.ast import ABSTRACT, ALL, DATE, MESH, TITLE, Boolean, Keyword, booleans, from_json, keywords, node_rows, to_json, walk
from ferrule.plans.parsers import QuerySyntaxError, parse_expression, parse_medline, parse_pubmed, to_medline, to_pubmed

LINES = """1. exp Heart Failure/
2. (heart adj2 failure).ti,ab.
3. "cardiac arrest".tw.
4. or/1-3
5. statin$.mp.
6. 4 and 5
7. Aged/
8. 6 not 7"""


def test_medline_lines():
    q = parse_medline(LINES)
    assert str(q) == (
        "(((Heart Failure+[mesh_headings] or (heart[title,abstract] adj2 failure[title,abstract]) or cardiac arrest[title,abstract]) and statin*[title,abstract,mesh_headings]) not Aged[mesh_headings])"
    )
    assert parse_medline(to_medline(q)) == q


def test_pubmed():
    q = parse_pubmed('(heart failure[Title/Abstract] OR "Heart Failure"[Mesh:noexp]) AND 2001/01:2010/12[Publication Date] NOT aged[mh]')
    assert q.operator == "not" and q.children[0].operator == "and"
    leaves = keywords(q)
    assert leaves[0] == Keyword("heart failure", (TITLE, ABSTRACT)) and leaves[1].exploded is False and leaves[2] == Keyword("2001/01:2010/12", (DATE,)) and leaves[3].exploded
    assert parse_pubmed(to_pubmed(q)) == q


def test_mixed_notation():
    q = parse_expression('(("hazard ratio".ti,ab. Adj2 variance[Title]) AND pucu*.tw.) or exp Biopsy/')
    assert [b.operator for b in booleans(q)] == ["or", "and", "adj2"]
    assert keywords(q)[2].truncated


@pytest.mark.parametrize("bad", ["", "(a or b", "a and", "or/1-2", "x[Nonsense]"])
def test_bad_queries_are_refused(bad):
    with pytest.raises(QuerySyntaxError):
        parse_medline(bad) if bad.startswith("or/") else parse_expression(bad)


def test_missing_line():
    with pytest.raises(QuerySyntaxError):
        parse_medline("1. a.ti.\n2. 1 and 7")


LEAF = st.builds(Keyword, st.text("abcdefg", min_size=2, max_size=6), st.sampled_from([(TITLE,), (ABSTRACT,), (TITLE, ABSTRACT), (ALL,)]))
TREE = st.recursive(LEAF, lambda c: st.builds(Boolean, st.sampled_from(["and", "or", "not"]), st.lists(c, min_size=2, max_size=4).map(tuple)), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(TREE)
def test_json_round_trip(q):
    assert from_json(to_json(q)) == q
    rows = node_rows(q)
    assert len(rows) == sum(1 for _ in walk(q)) and [r[0] for r in rows] == list(range(len(rows)))


@settings(max_examples=60, deadline=None)
@given(TREE)
def test_variations_are_single_edits(q):
    found = va.variations(va.Candidate(q, -1))
    names = [str(c.query) for c in found]
    assert len(set(names)) == len(names) and str(q) not in names
    for c in found:
        if c.transformation == va.CLAUSE_REMOVAL:
            assert len(keywords(c.query)) < len(keywords(q))
        elif c.transformation == va.LOGICAL:
            assert keywords(c.query) == keywords(q)


@settings(max_examples=60, deadline=None)
@given(TREE)
def test_rewrites_keep_keywords(q):
    assert keywords(rw.all_and(q)) == keywords(q) and {b.operator for b in booleans(rw.all_or(q))} <= {"or"}
    flat = rw.flatten(q)
    assert keywords(flat) == keywords(q)
    assert all(not (isinstance(c, Boolean) and c.operator == b.operator and b.operator in ("and", "or")) for b in booleans(flat) for c in b.children)


def test_rewrites():
    q = parse_medline(LINES)
    assert str(rw.relax_phrases(Keyword('"heart failure"'))) == "(heart[title,abstract] or failure[title,abstract])"
    assert all(k.exploded is False for k in keywords(rw.no_explosion(q)))
    kept, gone = rw.remove_mesh(q)
    assert [k.text for k in gone] == ["Heart Failure", "Aged"] and len(keywords(kept)) == len(keywords(q)) - 2
    assert rw.remove_mesh(Keyword("x", (MESH,)))[0] is None
    assert rw.rct_filter(Keyword("x")) == Keyword("x") and rw.rct_filter(q).operator == "and"
    assert rw.date_restriction(q, "1", {"1": ("2001/01", "2002/01")}).children[1].fields == (DATE,) and rw.date_restriction(q, "2", {}) == q
    assert rw.stem(Keyword("statins"), [Keyword("statin*", truncated=True)]).text == "statin*"
    assert [k.text for k in keywords(rw.title_clause("The cats running", ["the"]))] == ["cat*", "cats", "run*", "running"]
    assert keywords(rw.analysed_fields(q))[-2].fields[0].endswith(".stemmed")


def test_transformations_with_dictionaries():
    near = va.embedding_expansion({"heart": ["cardiac"]})(Keyword("heart"))
    assert [k.text for k in keywords(near[0])] == ["cardiac", "heart"]
    up = va.mesh_parent({"sepsis": ["Infections"]})(Keyword("Sepsis", (MESH,), True))
    assert up == [Keyword("Infections", (MESH,), False)]
    assert [b.operator for b in va.adjacency_range(Boolean("adj1", (Keyword("a"), Keyword("b"))))] == ["adj2"]
    assert va.variations(va.Candidate(Keyword("a", (TITLE,)), -1))[0].features[va.TRANSFORMATION] == va.FIELD_RESTRICTION


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
     ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("adjustable", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("is", "is")],
)
def test_porter(word, stem):
    assert tx.porter_stem(word) == stem


def test_text_columns(spark):
    df = spark.createDataFrame([("a  b!c", "The <b>Heart-rate</b> fell 2x. Again?! yes", "stat*"), ("", "", ""), (None, None, None)], "a string, b string, c string")
    r = df.select(
        tx.alpha_num("a"), tx.strip_numbers("b"), tx.letter_runs("b"), tx.letter_runs("b", compat=True), tx.terms("b"), F.size(tx.sentences("b")), tx.substring_count("b", F.lit("a")), tx.normalise("c"), tx.expand_truncated("c", ["in", "ins"]), tx.query_terms("a"),
    ).collect()
    assert r[0][0] == "a b c" and r[0][2] == ["the", "heart", "rate", "fell", "x", "again", "yes"] and r[0][3] == ["the", "rate", "fell", "yes"]
    assert r[0][4][:3] == ["the", "b", "heart"] and r[0][5] == 3 and r[0][6] == 3 and r[0][7] == "stat" and r[0][8] == ["stat", "statin", "statins"] and r[0][9] == ["a", "", "b!c"]
    assert r[1][0] == "" and r[1][2] == [] and r[1][9] == [""] and r[2][0] is None and r[2][4] is None


def test_keyphrases_and_stems(spark):
    df = spark.createDataFrame([(1, "Deep vein thrombosis and deep vein care, in adults"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.phrase: r.score for r in tx.keyphrases(df, "doc_id", "text").collect()}
    assert got == {"deep vein thrombosis": 9.0, "deep vein care": 9.0, "adults": 1.0}
    assert df.select(tx.stems(tx.terms("text"))).first()[0][2] == "thrombosi"
