"""Measurements of query structure over rows of query nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.text import normalise
from ferrule.plans.ast import ABSTRACT, MESH, MESH_FIELDS, NODE_FIELDS, TITLE


def nodes(queries: DataFrame, key: str = "topic", query: str = "query", parser: str = "cqr") -> DataFrame:
    """The nodes of every query as rows (see ``NODE_FIELDS``), parsed where they lie. Texts that cannot be parsed give no row."""
    import pandas as pd

    from ferrule.plans.ast import node_rows
    from ferrule.plans.parsers import PARSERS

    read = PARSERS[parser]
    names = [n for n, _ in NODE_FIELDS]
    schema = T.StructType([queries.schema[key], *[T.StructField(n, t) for n, t in NODE_FIELDS]])

    def run(batches):
        for pdf in batches:
            out = []
            for k, text in zip(pdf["__k"], pdf["__q"]):
                try:
                    out += [(k, *row) for row in node_rows(read(text))]
                except Exception:  # noqa: BLE001, S112
                    continue
            frame = pd.DataFrame(out, columns=[key, *names])
            for n in ("node_id", "parent_id", "ord", "depth", "top"):
                frame[n] = frame[n].astype("Int32")
            yield frame

    return queries.where(F.col(query).isNotNull()).select(F.col(key).alias("__k"), F.col(query).alias("__q")).mapInPandas(run, schema)


def _kw() -> Column:
    return F.col("kind") == "kw"


def _has(*fields: str) -> Column:
    return _kw() & F.arrays_overlap("fields", F.array(*map(F.lit, fields)))


def _op(name: str) -> Column:
    return F.col("operator") == name


def counts(nodes_: DataFrame, key: str = "topic", compat: bool = False) -> DataFrame:
    """One row of counts per query: keywords, fields, Boolean nodes and clauses, operators (adj counts as and), headings, truncation and explosion.

    ``compat`` counts every inner node but the root twice, as the classic measure does.
    """
    booleans = F.count_if(F.col("kind") == "bool")
    fields = F.explode_outer("fields")
    per_field = nodes_.where(_kw()).select(key, fields.alias("f")).groupBy(key).agg(
        F.count("f").alias("fields"), F.count_if(F.col("f") == TITLE).alias("fields_title"), F.count_if(F.col("f") == ABSTRACT).alias("fields_abstract"), F.count_if(F.col("f").isin(*MESH_FIELDS)).alias("fields_mesh"),
    )
    rows = nodes_.groupBy(key).agg(
        F.count_if(_kw()).alias("keywords"), (2 * booleans - 1 if compat else booleans).alias("boolean_nodes"), F.count_if(_op("and") | F.col("operator").startswith("adj")).alias("and_clauses"),
        F.count_if(_op("or")).alias("or_clauses"), F.count_if(_op("not")).alias("not_clauses"), F.count_if(F.col("operator").startswith("adj")).alias("adj_clauses"),
        F.count_if((F.col("kind") == "bool") & (F.col("depth") > 0)).alias("non_atomic"), F.count_if(F.col("truncated")).alias("truncated"), F.count_if(_has(MESH)).alias("mesh_keywords"),
        F.count_if(_has(MESH) & F.col("exploded")).alias("mesh_exploded"), F.count_if(_has(MESH) & ~F.col("exploded")).alias("mesh_non_exploded"),
        F.sum(F.when(_kw(), F.size(F.split("query_string", " "))).otherwise(0)).alias("terms"), F.max("depth").alias("depth"),
    )
    return rows.join(per_field, key, "left").na.fill(0).withColumn("fields_other", F.col("fields") - F.col("fields_title") - F.col("fields_abstract") - F.col("fields_mesh"))


def complexity(nodes_: DataFrame, key: str = "topic") -> DataFrame:
    """(key, complexity): over the root's children, (sum of inner nodes / sum of keywords) / children, times the number of nodes; 0 without keywords."""
    below = F.col("depth") >= 1
    c = nodes_.groupBy(key).agg(F.count_if(below & (F.col("kind") == "bool")).alias("b"), F.count_if(below & _kw()).alias("k"), F.count_if(F.col("depth") == 1).alias("children"), F.count_if(below).alias("n"))
    return c.select(key, F.when(F.col("k") > 0, F.col("b") / F.col("k") / F.col("children") * F.col("n")).otherwise(0.0).alias("complexity"))


def mesh_depths(nodes_: DataFrame, mesh: DataFrame, key: str = "topic") -> DataFrame:
    """(key, avg_depth, max_depth) of headings in a tree (heading, tree_number), a heading's depth being that of its shallowest place; 0 without headings."""
    tree = mesh.groupBy(F.lower("heading").alias("h")).agg(F.min(F.size(F.split("tree_number", r"\."))).alias("d"))
    held = nodes_.where(_has(MESH)).select(key, F.lower(normalise("query_string")).alias("h")).join(tree, "h")
    every = nodes_.select(key).distinct()
    return every.join(held.groupBy(key).agg(F.avg("d").alias("avg_depth"), F.max("d").alias("max_depth")), key, "left").na.fill(0)


def explosion_ratio(c: DataFrame, key: str = "topic") -> DataFrame:
    """(key, ratio, addition, reduction): exploded over all headings, with the two probability pairs of the measure m: (-ln m, 1 + ln m) and (1 + ln m, -ln m)."""
    m = F.when(F.col("mesh_keywords") > 0, F.col("mesh_exploded") / F.col("mesh_keywords")).otherwise(0.0)
    ln = F.when(m > 0, F.log(m))
    return c.select(key, m.alias("ratio"), F.struct((-ln).alias("a"), (1 + ln).alias("b")).alias("addition"), F.struct((1 + ln).alias("a"), (-ln).alias("b")).alias("reduction"))


def string_reachability(nodes_: DataFrame, protocols: DataFrame, sections: list[str], key: str = "topic") -> DataFrame:
    """(key, keywords, n_section...): the keywords that occur in each section of the topic's protocol, without regard to case."""
    k = nodes_.where(_kw()).select(key, F.lower(normalise("query_string")).alias("q"))
    joined = k.join(protocols.select(key, *sections), key)
    hit = lambda c: F.count_if((F.length("q") > 0) & F.contains(F.lower(F.coalesce(c, F.lit(""))), F.col("q"))).alias(f"n_{c}")
    return joined.groupBy(key).agg(F.count(F.lit(1)).alias("keywords"), *[hit(c) for c in sections])


def concept_reachability(query_concepts: DataFrame, section_concepts: DataFrame, key: str = "topic") -> DataFrame:
    """(key, section, shared, either, ratio): overlap of a query's concepts with those of each protocol section; inputs (key, cui), (key, section, cui)."""
    q = query_concepts.groupBy(key).agg(F.collect_set("cui").alias("q"))
    p = section_concepts.groupBy(key, "section").agg(F.collect_set("cui").alias("p"))
    s, e = F.size(F.array_intersect("q", "p")), F.size(F.array_union("q", "p"))
    return p.join(q, key).select(key, "section", s.alias("shared"), e.alias("either"), F.when(e > 0, s / e).otherwise(0.0).alias("ratio"))


def concept_score_distributions(scored: DataFrame, query_concepts: DataFrame, key: str = "topic") -> DataFrame:
    """(key, inside, outside): sorted absolute scores of concepts that the query has, and of those it lacks; ``scored`` is (key, cui, score)."""
    flagged = scored.join(query_concepts.select(key, "cui", F.lit(True).alias("inq")).distinct(), [key, "cui"], "left")
    return flagged.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("inq"), F.abs("score")))).alias("inside"), F.array_sort(F.collect_list(F.when(F.col("inq").isNull(), F.abs("score")))).alias("outside"))


def measured(counted: DataFrame, names: list[str], key: str = "topic") -> DataFrame:
    """(key, name, value): the counts of some names in long form, as the measurement writers take them."""
    return counted.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])))
