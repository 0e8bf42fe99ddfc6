"""Formulating queries from judged documents, concepts and embeddings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators.evaluate import evaluate, registry
from ferrule.plans.ast import ABSTRACT, MESH, TITLE, Boolean, Keyword, Node
from ferrule.plans.boolean import index_fields
from ferrule.tables import durable, written


def split_order(doc_id: Column | str = "doc_id", seed: int = 1000) -> Column:
    """A fixed pseudo-random key that other engines can compute too."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod((c % 1_000_003) * 7_919 + seed * 104_729, F.lit(1_000_003))


def split(judged: DataFrame, seed: int = 1000, keys: list[str] = ["topic"]) -> DataFrame:  # noqa: B006
    """Adds part: the first half of each topic's documents in the seeded order is ``dev``, the next quarter ``val``, the rest ``unseen``."""
    n = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy(split_order(seed=seed), "doc_id")
    i = judged.withColumn("_i", F.row_number().over(order) - 1).join(n, keys)
    part = F.when(F.col("_i") < F.floor(F.col("_n") / 2), "dev").when(F.col("_i") < F.floor(F.col("_n") * 3 / 4), "val").otherwise("unseen")
    return i.withColumn("part", part).drop("_i", "_n")


def document_frequencies(docs_terms: DataFrame, keys: list[str] = ["topic"]) -> DataFrame:  # noqa: B006
    """(keys, term, df) of rows (keys, doc_id, term)."""
    return docs_terms.groupBy(*keys, "term").agg(F.count_distinct("doc_id").alias("df"))


def cut_development(freq: DataFrame, sizes: DataFrame, cut: float) -> DataFrame:
    """Terms in at least ``cut`` of the topic's development documents; ``sizes`` has (topic, size)."""
    return freq.join(sizes, "topic").where(F.col("df") >= cut * F.col("size")).drop("size")


def cut_population(freq: DataFrame, population: DataFrame, size: DataFrame, cut: float) -> DataFrame:
    """Terms that the population has, but in at most ``cut`` of its documents; ``population`` (term, pop_df), ``size`` one row (pop_size)."""
    return freq.join(population, "term", "left").crossJoin(F.broadcast(size)).where((F.coalesce("pop_df", F.lit(0)) > 0) & (F.col("pop_df") <= cut * F.col("pop_size"))).drop("pop_size")


def rank_terms(freq: DataFrame, sizes: DataFrame) -> DataFrame:
    """(topic, term, df, share, position), most frequent first, ties by term."""
    order = Window.partitionBy("topic").orderBy(F.col("df").desc(), "term")
    return freq.join(sizes, "topic").select("topic", "term", "df", (F.col("df") / F.col("size")).alias("share"), F.row_number().over(order).alias("position"))


def entropy(p: Column) -> Column:
    q = 1 - p
    return F.when((p > 0) & (q > 0), -(p * F.log2(p) + q * F.log2(q))).otherwise(0.0)


def information_gain(labelled_terms: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, n_with, pos_with, gain): entropy of the labels less that of the two parts a term makes.

    ``labels`` is (doc_id, label), ``labelled_terms`` (doc_id, term). One aggregation by term; documents without the term come from the totals.
    """
    total = labels.agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("pos"))
    per = labelled_terms.join(labels, "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("n_with"), F.count_if("label").alias("pos_with")).crossJoin(F.broadcast(total))
    return per.select("term", "n_with", "pos_with", _gain().alias("gain"))


def _gain() -> Column:
    """The gain of rows with n, pos, n_with, pos_with."""
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n, w = F.col("n"), F.col("n_with")
    return entropy(rate(F.col("pos"), n)) - w / n * entropy(rate(F.col("pos_with"), w)) - (n - w) / n * entropy(rate(F.col("pos") - F.col("pos_with"), n - w))


@dataclass
class Tree:
    """A decision tree over the presence of terms: a leaf has ``label``, an inner node ``term`` and two branches."""

    label: bool | None = None
    term: str = ""
    present: "Tree | None" = None
    absent: "Tree | None" = None


#: A node of at most this many (document, term) rows is grown to its leaves by one task.
LOCAL_ROWS = 1_000_000


def _grow(rows, depth: int | None, min_docs: int) -> list:
    """The subtree of rows (doc_id, label, term or null) in pre-order: the term of an inner node, the label of a leaf; ``depth`` levels at most."""
    import numpy as np
    import pandas as pd

    doc, ids = pd.factorize(rows["doc_id"])
    y = np.zeros(len(ids), bool)
    y[doc] = rows["label"].to_numpy(bool)
    has = rows["term"].notna().to_numpy()
    words, term = np.unique(rows["term"][has].to_numpy(str), return_inverse=True)

    def h(pos, n):
        p = np.divide(pos, n, out=np.zeros(len(pos)), where=n > 0)
        mixed = (p > 0) & (p < 1)
        q = np.where(mixed, p, 0.5)
        return np.where(mixed, -(q * np.log2(q) + (1 - q) * np.log2(1 - q)), 0.0)

    out, stack = [], [(np.arange(len(ids)), doc[has], term, 0)]
    while stack:
        docs, d, t, level = stack.pop()
        n, pos = len(docs), int(y[docs].sum())
        gain = np.zeros(0)
        if level != depth and n >= min_docs and 0 < pos < n:
            held, at = np.unique(t, return_inverse=True)
            w, p = np.bincount(at, minlength=len(held)), np.bincount(at, y[d], minlength=len(held))
            gain = h(np.array([pos]), np.array([n])) - w / n * h(p, w) - (n - w) / n * h(pos - p, n - w)
        if not (gain > 1e-9).any():
            out.append(2 * pos >= n)
            continue
        best = held[np.argmax(np.round(gain, 9))]
        out.append(str(words[best]))
        with_term = np.zeros(len(ids), bool)
        with_term[d[t == best]] = True
        for side in (~with_term, with_term):
            stack.append((docs[side[docs]], d[side[d]], t[side[d]], level + 1))
    return out


def id3(terms: DataFrame, labels: DataFrame, candidates: list[str] | None = None, max_depth: int | None = None, min_docs: int = 2, local_rows: int = LOCAL_ROWS) -> Tree:
    """ID3 on the presence of terms, until leaves are pure or no term has a gain.

    All nodes of a level are split by one aggregation, and the documents' nodes are written to the checkpoint folder; a node of few rows
    is grown to its leaves by one task. The driver sees one term and two counts per node.
    """
    import json

    import pandas as pd

    held = durable((terms if candidates is None else terms.where(F.col("term").isin(candidates))).select("doc_id", "term").distinct())
    sizes = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    at = durable(labels.select("doc_id", "label", F.lit(0).alias("node")))
    root = Tree()
    nodes, level = {0: root}, 0
    while nodes:
        totals = {r.node: r for r in at.join(sizes, "doc_id", "left").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("pos"), F.sum(F.coalesce("k", F.lit(1))).alias("size")).collect()}
        mixed = [] if level == max_depth else [r for r in totals.values() if r.n >= min_docs and 0 < r.pos < r.n]
        small, large = [r.node for r in mixed if r.size <= local_rows], [r for r in mixed if r.size > local_rows]
        for k, tree in nodes.items():
            tree.label = k in totals and 2 * totals[k].pos >= totals[k].n
        if small:
            depth = None if max_depth is None else max_depth - level
            grow = lambda key, rows: pd.DataFrame({"node": [int(key[0])], "tree": [json.dumps(_grow(rows, depth, min_docs), default=bool)]})  # noqa: B023, E731
            for r in at.where(F.col("node").isin(small)).join(held, "doc_id", "left").groupBy("node").applyInPandas(grow, "node int, tree string").collect():
                stack = [nodes[r.node]]
                for item in json.loads(r.tree):
                    tree = stack.pop()
                    if isinstance(item, bool):
                        tree.label = item
                    else:
                        tree.label, tree.term, tree.present, tree.absent = None, item, Tree(), Tree()
                        stack += [tree.absent, tree.present]
        if not large:
            break
        spark = labels.sparkSession
        counts = spark.createDataFrame([(r.node, r.n, r.pos) for r in large], "node int, n long, pos long")
        per = at.join(held, "doc_id").groupBy("node", "term").agg(F.count(F.lit(1)).alias("n_with"), F.count_if("label").alias("pos_with")).join(F.broadcast(counts), "node")
        gains = per.withColumn("gain", _gain()).where("gain > 1e-9")
        best = gains.groupBy("node").agg(F.min(F.struct((-F.round("gain", 9)).alias("g"), "term")).alias("best")).select("node", "best.term").collect()
        grown, chosen = {}, []
        for r in best:
            tree = nodes[r.node]
            tree.label, tree.term, tree.present, tree.absent = None, r.term, Tree(), Tree()
            chosen.append((r.node, r.term, len(grown)))
            grown |= {len(grown): tree.present, len(grown) + 1: tree.absent}
        if chosen:
            split_by = F.broadcast(spark.createDataFrame(chosen, "node int, term string, child int"))  # one row per node of the level
            placed = at.join(split_by, "node").join(held.withColumn("has", F.lit(True)), ["doc_id", "term"], "left")
            at = durable(placed.select("doc_id", "label", F.when(F.col("has"), F.col("child")).otherwise(F.col("child") + 1).alias("node")))
        nodes, level = grown, level + 1
    return root


def tree_query(tree: Tree, fields: tuple[str, ...] = (TITLE, ABSTRACT)) -> Node | None:
    """The disjunction of the paths to positive leaves; a path is its terms, without those it lacks. A path of only absent terms cannot be a query."""
    paths: list[tuple[list[str], list[str]]] = []

    stack: list[tuple[Tree, list[str], list[str]]] = [(tree, [], [])]
    while stack:
        t, yes, no = stack.pop()
        if t.term:
            stack += [(t.absent, yes, [*no, t.term]), (t.present, [*yes, t.term], no)]
        elif t.label and yes:
            paths.append((yes, no))
    kw = lambda w: Keyword(w, fields)
    join = lambda op, ws: kw(ws[0]) if len(ws) == 1 else Boolean(op, tuple(map(kw, ws)))
    parts = [Boolean("not", (join("and", y), *map(kw, n))) if n else join("and", y) for y, n in paths]
    return None if not parts else parts[0] if len(parts) == 1 else Boolean("or", tuple(parts))


def top_headings(docs: DataFrame, k: int, rejected: list[str], keys: list[str] = ["topic"]) -> DataFrame:  # noqa: B006
    """(topic, heading, df): the k most frequent headings of each topic's documents, without the rejected ones."""
    h = docs.select(*keys, "doc_id", F.explode("mh").alias("h")).select(*keys, "doc_id", F.lower(F.trim("h")).alias("heading")).where(F.col("heading").isNotNull() & (F.col("heading") != "") & ~F.col("heading").isin(rejected))
    freq = h.groupBy(*keys, "heading").agg(F.count_distinct("doc_id").alias("df"))
    return freq.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("df").desc(), "heading"))).where(F.col("_i") <= k).drop("_i")


def classify(terms: DataFrame, types: DataFrame) -> DataFrame:
    """(…, category): condition, treatment, study_type or other, from a dimension (term, semantic_type)."""
    conditions = ["dsyn", "neop", "sosy", "patf", "mobd", "fndg"]
    treatments = ["topp", "phsu", "diap", "clnd", "antb", "medd"]
    studies = ["resa", "mnob", "lbpr"]
    t = F.col("semantic_type")
    return terms.join(types, "term", "left").withColumn("category", F.when(t.isin(conditions), "condition").when(t.isin(treatments), "treatment").when(t.isin(studies), "study_type").otherwise("other")).drop("semantic_type")


def unique_coverage(term_docs: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, category, term, unique_docs): how many documents of the joint coverage only this term of its category reaches.

    ``term_docs`` is (keys, category, term, doc_id). The joint coverage is the documents that every category reaches; a term with
    0 can be left out without changing it.
    """
    rows = term_docs.select(*keys, "category", "term", "doc_id").distinct()
    reached = rows.groupBy(*keys, "doc_id").agg(F.count_distinct("category").alias("c"))
    categories = rows.groupBy(*keys).agg(F.count_distinct("category").alias("all"))
    full = reached.join(categories, keys) if keys else reached.crossJoin(F.broadcast(categories))  # one row
    hits = rows.join(full.where("c = all").select(*keys, "doc_id"), [*keys, "doc_id"], "left_semi")
    only = hits.groupBy(*keys, "category", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("term").alias("term")).where("k = 1").groupBy(*keys, "category", "term").agg(F.count(F.lit(1)).alias("u"))
    return rows.select(*keys, "category", "term").distinct().join(only, [*keys, "category", "term"], "left").select(*keys, "category", "term", F.coalesce("u", F.lit(0)).alias("unique_docs"))


def map_concepts(terms: DataFrame, mapping: DataFrame) -> DataFrame:
    """Terms with their concepts from a dimension (term, cui, abbreviation); terms without one keep nulls."""
    return terms.join(mapping, "term", "left")


def keywords_for_concepts(concepts: DataFrame, names: DataFrame, how: str = "preferred", k: int = 5) -> DataFrame:
    """(cui, term): by ``how`` the preferred name, the most frequent one, all aliases, or the k most frequent; ``names`` is (cui, term, preferred, freq)."""
    n = concepts.select("cui").distinct().join(names, "cui")
    order = Window.partitionBy("cui").orderBy(F.col("freq").desc(), "term")
    if how == "preferred":
        return n.where("preferred").select("cui", "term")
    if how == "alias":
        return n.select("cui", "term").distinct()
    return n.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= (1 if how == "frequent" else k)).select("cui", "term")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0, block: int = 1024, part_rows: int = 20_000) -> DataFrame:
    """(query_id, vec_id, similarity): the k nearest vectors by cosine of each query vector, itself left out; ties by id.

    The stated queries meet all vectors in blocks: each group multiplies about ``part_rows`` vectors with a block of about
    ``block`` queries and sends on its k best per query; the numbers of blocks and parts follow the two counts. Null or empty vectors and zero vectors have similarity 0.
    """
    import numpy as np
    import pandas as pd

    n, parts = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // part_rows))
    q = queries.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qe"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("b")).where("qe IS NOT NULL AND size(qe) > 0")
    blocks = q.groupBy("b").agg(F.collect_list(F.struct("qid", "qe")).alias("qs"))
    spread = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"), F.pmod(F.hash("vec_id"), F.lit(parts)).alias("p"))

    def unit(rows) -> np.ndarray:
        x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def multiply(key, left, right):
        out = []
        if len(left) and len(right):
            qs = right["qs"].iloc[0]
            ids = left["vec_id"].to_numpy()
            sims = unit([r["qe"] for r in qs]) @ unit(left["embedding"]).T
            for row, s in zip(qs, sims):
                s = np.where(ids == row["qid"], -np.inf, np.round(s, 9))
                best = np.lexsort((ids, -s))[:k]
                out += [(row["qid"], int(ids[i]), float(s[i])) for i in best if s[i] > -np.inf]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "similarity"]).astype({"query_id": "int64", "vec_id": "int64", "similarity": "float64"})

    copies = blocks.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    part = spread.groupBy("b", "p").cogroup(copies.groupBy("b", "p")).applyInPandas(multiply, "query_id long, vec_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return part.where(F.col("similarity") > least).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= k).drop("_i")


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """(group, centroid): the mean vector of each group, element by element, summed before the shuffle."""
    e = vectors.where(F.col("embedding").isNotNull()).select(group, F.posexplode("embedding").alias("i", "v"))
    means = e.groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))


def relevance_feedback(clauses: DataFrame, feedback: DataFrame) -> DataFrame:
    """(term, clause_id, similarity): each feedback term to the clause whose centroid it is most similar to.

    ``clauses`` is (clause_id, embedding) of clause terms, ``feedback`` (term, embedding). The number of clauses is that of one query.
    """
    c = centroids(clauses, "clause_id")
    sims = feedback.crossJoin(F.broadcast(c)).select("term", "clause_id", cosine(F.col("embedding"), F.col("centroid")).alias("similarity"))
    return sims.withColumn("_i", F.row_number().over(Window.partitionBy("term").orderBy(F.col("similarity").desc(), "clause_id"))).where("_i = 1").drop("_i")


def compose_by_similarity(terms: list[tuple[str, list[float]]], least: float = 0.3) -> Node | None:
    """Terms of one text greedily grouped by cosine to a group's first term; groups are disjunctions, joined by and. Tiny input, on the driver."""
    import math

    groups: list[list[tuple[str, list[float]]]] = []
    for t, v in terms:
        for g in groups:
            u = g[0][1]
            n = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
            if n and sum(x * y for x, y in zip(u, v)) / n > least:
                g.append((t, v))
                break
        else:
            groups.append([(t, v)])
    parts = [Keyword(g[0][0]) if len(g) == 1 else Boolean("or", tuple(Keyword(t) for t, _ in g)) for g in groups]
    return None if not parts else parts[0] if len(parts) == 1 else Boolean("and", tuple(parts))


def parse_tree(text: str) -> tuple:
    """A bracketed constituency tree as nested (label, children or word)."""
    import re

    tokens, at = re.findall(r"\(|\)|[^\s()]+", text), 0

    def node():
        nonlocal at
        at += 1
        label, children = tokens[at], []
        at += 1
        while tokens[at] != ")":
            if tokens[at] == "(":
                children.append(node())
            else:
                children.append(tokens[at])
                at += 1
        at += 1
        return (label, children)

    return node()


def tree_to_query(tree: tuple) -> Node | None:
    """Noun phrases joined by and; coordinated ones by or. Words of nouns and adjectives become keywords, neighbours one phrase."""
    label, children = tree
    if all(isinstance(c, str) for c in children):
        return Keyword(" ".join(children)) if label[:2] in ("NN", "JJ") else None
    words = [c for c in children if isinstance(c, tuple)]
    joined = any(c[0] == "CC" and c[1] == ["or"] for c in words)
    parts, phrase = [], []
    for c in [*words, None]:
        leaf = c is not None and all(isinstance(x, str) for x in c[1])
        if leaf and c[0][:2] in ("NN", "JJ"):
            phrase += c[1]
            continue
        if phrase:
            parts.append(Keyword(" ".join(phrase)))
            phrase = []
        if c is not None and not leaf and (q := tree_to_query(c)) is not None:
            parts.append(q)
    return None if not parts else parts[0] if len(parts) == 1 else Boolean("or" if joined else "and", tuple(parts))


#: The category of all terms where no dimension of semantic types tells them apart.
ANY = "any"
#: The measures of a formulated query.
OBJECTIVE_MEASURES = ("num_rel", "num_ret", "num_rel_ret", "recall", "precision", "f1", "f0.5", "f3", "nnr")


Groups = dict[str, list[Keyword]]


def category_hits(queries: dict[str, Groups], postings: DataFrame) -> DataFrame:
    """(topic, doc_id): what ``category_query`` of each of many groups of single terms and headings retrieves.

    A join of the postings with the queries' terms and two counts: the plan is the same for any number of queries and terms.
    """
    spark = postings.sparkSession
    rows = [(name, c, k.text.lower(), f) for name, groups in queries.items() for c, ks in groups.items() for k in ks for f in index_fields(k)]
    wanted = spark.createDataFrame(sorted(set(rows)), "topic string, category string, term string, field string") if rows else spark.createDataFrame([], "topic string, category string, term string, field string")
    needed = spark.createDataFrame([(name, sum(bool(ks) for ks in groups.values())) for name, groups in queries.items()], "topic string, needed long")
    reached = postings.select("doc_id", "term", "field").join(wanted, ["term", "field"]).groupBy("topic", "doc_id").agg(F.count_distinct("category").alias("reached"))
    return reached.join(F.broadcast(needed), "topic").where("reached = needed").select("topic", "doc_id")  # one row a query


def category_query(groups: Groups) -> Node | None:
    """The conjunction over categories of the disjunction of each one's keywords; categories without keywords are left out."""
    parts = [Boolean("or", tuple(ks)) for _, ks in sorted(groups.items()) if ks]
    return None if not parts else parts[0] if len(parts) == 1 else Boolean("and", tuple(parts))


@dataclass(frozen=True)
class ObjectiveFormulator:
    """Queries from judged documents: cut-offs on development and population frequency are tried and the terms best on validation are kept.

    Terms are sorted into conditions, treatments and study types by their semantic types where these are given, others are dropped, and so are
    terms that no document of the joint coverage needs; the query is the conjunction of the categories. Without types all terms are one category.
    Then numbers of the most frequent headings are added to these terms, to every category that has any, and the best on validation is kept again.
    """

    dev_cuts: tuple[float, ...] = (0.15, 0.20, 0.25, 0.30)
    pop_cuts: tuple[float, ...] = (0.001, 0.01, 0.02)
    mesh_counts: tuple[int, ...] = (1, 5, 10, 15, 20)
    rejected_headings: tuple[str, ...] = ("humans", "male", "female", "adult", "aged", "child")
    seed: int = 1000
    trace: list = field(default_factory=list, compare=False)

    def formulate(self, spark: SparkSession, judged: DataFrame, docs: DataFrame, terms: DataFrame, postings: DataFrame, types: DataFrame | None = None) -> tuple[Node | None, Node | None]:
        """The query of terms, and that of the same terms with headings."""
        return tuple(category_query(groups) for groups in self.choose(spark, judged, docs, terms, postings, types))

    def choose(self, spark: SparkSession, judged: DataFrame, docs: DataFrame, terms: DataFrame, postings: DataFrame, types: DataFrame | None = None) -> tuple[Groups, Groups]:
        """The keywords of both queries by category.

        ``judged`` (topic, doc_id) are the relevant documents of one topic, ``terms`` (doc_id, term) of the collection, ``postings`` its index,
        ``types`` (term, semantic_type) a vocabulary.
        """
        parts = written(split(judged, self.seed))
        dev, val = parts.where("part = 'dev'"), parts.where("part = 'val'").select("doc_id")
        size = dev.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
        dev_terms = written(dev.join(terms, "doc_id").select("topic", "doc_id", "term"))
        freq = document_frequencies(dev_terms)
        population = terms.groupBy("term").agg(F.count_distinct("doc_id").alias("pop_df"))
        n_dev, n_docs = dev.count(), docs.count()
        # Terms in a share of the development documents: no more than a document's terms divided by the share.
        widest = cut_population(cut_development(freq, size, min(self.dev_cuts)), population, docs.agg(F.count(F.lit(1)).alias("pop_size")), max(self.pop_cuts))
        sorted_terms = widest.withColumn("category", F.lit(ANY)) if types is None else classify(widest, types).where("category <> 'other'")
        rows = sorted_terms.orderBy(F.col("df").desc(), "term", "category").collect()
        cells = {f"{d}/{p}": [r for r in rows if r.df >= d * n_dev and r.pop_df <= p * n_docs] for d in self.dev_cuts for p in self.pop_cuts}
        if types is not None:
            cells = self._needed(spark, cells, dev_terms)
        options = {name: self._groups(held) for name, held in cells.items()}
        found = self._best(options, val, postings)
        headings = [Keyword(r.heading, (MESH,), True) for r in top_headings(dev.join(docs.select("doc_id", "mh"), "doc_id"), max(self.mesh_counts), list(self.rejected_headings)).orderBy(F.col("df").desc(), "heading").collect()]
        widened = self._best({f"mesh {k}": {c: [*ks, *headings[:k]] for c, ks in (found or {ANY: []}).items()} for k in self.mesh_counts}, val, postings)
        return found, widened

    @staticmethod
    def _groups(rows: list) -> Groups:
        out: Groups = {}
        for r in rows:
            out.setdefault(r.category, []).append(Keyword(r.term))
        return out

    @staticmethod
    def _needed(spark: SparkSession, cells: dict[str, list], dev_terms: DataFrame) -> dict[str, list]:
        """The cells without the terms that none of the development documents in their joint coverage needs, all cells in one plan."""
        listed = [(name, r.category, r.term) for name, held in cells.items() for r in held]
        if not listed:
            return cells
        held = dev_terms.join(spark.createDataFrame(listed, "cell string, category string, term string"), "term").select("cell", "category", "term", "doc_id")
        keep = {(r.cell, r.category, r.term) for r in unique_coverage(held, ["cell"]).where("unique_docs > 0").collect()}
        return {name: [r for r in rows if (name, r.category, r.term) in keep] for name, rows in cells.items()}

    def _best(self, options: dict[str, Groups], val: DataFrame, postings: DataFrame) -> Groups:
        """The keywords of the option whose query has the best F1 on the validation documents, of equal ones the first."""
        options = {name: groups for name, groups in options.items() if any(groups.values())}
        if not options:
            return {}
        n_val = val.count()
        flagged = category_hits(options, postings).join(val.withColumn("rel", F.lit(1)), "doc_id", "left").groupBy("topic").agg(F.count(F.lit(1)).alias("ret"), F.count("rel").alias("rel_ret"))
        scores = {r.topic: 2 * r.rel_ret / (r.ret + n_val) for r in flagged.collect()}  # one row per tried query
        self.trace.extend((name, round(scores.get(name, 0.0), 6)) for name in options)
        return options[max(options, key=lambda name: scores.get(name, 0.0))]


def objective_measures(parts: DataFrame, queries: dict[str, Groups], postings: DataFrame) -> DataFrame:
    """(part, query, name, value): the nine measures of each query against the documents of each part (``parts``: part, doc_id), all in one pass."""
    qrels = parts.select(F.col("part").alias("topic"), "doc_id", F.lit(1).alias("grade"))
    hits = category_hits(queries, postings).select(F.col("topic").alias("run_name"), "doc_id", F.explode(F.array(*map(F.lit, ("dev", "val", "unseen")))).alias("topic"))
    known = registry(1)
    run = hits.withColumns({"score": F.lit(0.0), "rn": F.col("doc_id")})
    return evaluate(run, qrels, {n: known[n] for n in OBJECTIVE_MEASURES}).select(F.col("topic").alias("part"), F.col("run_name").alias("query"), "name", "value")
