"""Experiments: queries are read, rewritten, measured, executed, evaluated and written in one description."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import evaluate as ev
from ferrule.operators import fusion as fu
from ferrule.operators import scorers as sc
from ferrule.operators import structure as st
from ferrule.plans.ast import Node, keywords, to_json
from ferrule.plans.boolean import as_run, matching
from ferrule.plans.rewrites import REWRITES
from ferrule.sources import readers, writers

MEASUREMENTS = ["keywords", "boolean_nodes", "and_clauses", "or_clauses", "not_clauses", "adj_clauses", "non_atomic", "truncated", "mesh_keywords", "mesh_exploded", "mesh_non_exploded", "terms", "depth", "fields", "fields_title", "fields_abstract", "fields_mesh", "fields_other"]


@dataclass(frozen=True)
class Experiment:
    """What to do with a set of queries (topic -> tree). Nothing runs until an output is used.

    ``retrieval`` is ``boolean`` (the matching documents by number), ``fusion`` (ranked fusion of the query's tree) or the
    name of a scorer over the query's words.
    """

    queries: Mapping[str, Node]
    preprocess: tuple[str, ...] = ()
    transforms: tuple[Callable[[Node], Node | None], ...] = ()
    measurements: tuple[str, ...] = ()
    evaluations: tuple[str, ...] = ()
    retrieval: str = "boolean"
    fields: tuple[str, ...] = ("ti", "ab")
    run_name: str = "run"
    grade: int = 0
    handlers: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    outputs: tuple[tuple[str, str], ...] = field(default=())

    @property
    def prepared(self) -> dict[str, Node]:
        """The rewritten queries, those of fewest inner nodes first; a query that a rewrite leaves empty is dropped."""
        out = {}
        for topic, node in sorted(self.queries.items(), key=lambda x: (len(to_json(x[1])), x[0])):
            for fn in (*(REWRITES[name] for name in self.preprocess), *self.transforms):
                node = None if node is None else fn(node)
            if node is not None:
                out[topic] = node
        return out

    def measured(self, spark: SparkSession) -> DataFrame:
        """(topic, name, value)."""
        rows = spark.createDataFrame([(t, to_json(n)) for t, n in self.prepared.items()], "topic string, query string")
        return st.measured(st.counts(st.nodes(rows)), list(self.measurements or MEASUREMENTS))

    def executed(self, collection: sc.Collection) -> DataFrame:
        """Run rows of all topics in one plan."""
        prepared = self.prepared
        if self.retrieval == "boolean":
            run = as_run(matching(prepared, collection.postings, collection.docs), self.run_name)
        elif self.retrieval == "fusion":
            run = sc.rank(fu.fuse_tree(prepared, collection), self.run_name)
        else:
            spark = collection.postings.sparkSession
            terms = [(t, w) for t, n in prepared.items() for k in keywords(n) for w in k.text.lower().replace('"', "").rstrip("*").split()]
            run = sc.rank(sc.SCORERS[self.retrieval](collection, spark.createDataFrame(terms, "topic string, term string"), list(self.fields)), self.run_name)
        for handler in self.handlers:
            run = handler(run)
        return run

    def evaluated(self, collection: sc.Collection, qrels: DataFrame, collection_size: int) -> DataFrame:
        """(topic, run_name, name, value)."""
        known = ev.registry(collection_size, self.grade)
        return ev.evaluate(ev.ranked(self.executed(collection)), qrels, {n: known[n] for n in self.evaluations})

    def run(self, spark: SparkSession, collection: sc.Collection, qrels: DataFrame | None = None, collection_size: int = 0) -> dict[str, DataFrame]:
        """The results by kind, written to the outputs that ask for them (``measurements.csv``, ``measurements.json``, ``run.trec``, ``evaluation.json``)."""
        results = {"measurements": self.measured(spark), "run": self.executed(collection)}
        if qrels is not None and self.evaluations:
            results["evaluation"] = self.evaluated(collection, qrels, collection_size)
        names = list(self.measurements or MEASUREMENTS)
        sinks = {
            "measurements.csv": lambda p: writers.write_measurements_csv(results["measurements"], p, names), "measurements.json": lambda p: writers.write_measurements_json(results["measurements"], p, names),
            "run.trec": lambda p: writers.write_run(results["run"], p), "evaluation.json": lambda p: writers.write_evaluation_json(results["evaluation"], p),
        }
        for kind, path in self.outputs:
            sinks[kind](path)
        return results


def load_experiment(spark: SparkSession, text: str) -> Experiment:
    """An experiment from its JSON description: query{format, path}, preprocess[], measurements[], evaluations[], output.measurements[{format, filename}], output.trec, retrieval."""
    raw = json.loads(text)
    source = raw.get("query") or {}
    rows = readers.read_queries(spark, source["path"], source.get("format", "medline")).collect()  # the queries of one experiment
    from ferrule.plans.ast import from_json

    failed = [f"{r.topic}: {r.error}" for r in rows if r["query"] is None]
    if failed:
        raise ValueError("; ".join(failed))
    out = raw.get("output") or {}
    outputs = [(f"measurements.{o['format']}", o["filename"]) for o in out.get("measurements") or []] + ([("run.trec", out["trec"])] if out.get("trec") else []) + ([("evaluation.json", out["evaluation"])] if out.get("evaluation") else [])
    return Experiment({r.topic: from_json(r["query"]) for r in rows}, tuple(raw.get("preprocess") or ()), (), tuple(raw.get("measurements") or ()), tuple(raw.get("evaluations") or ()), raw.get("retrieval", "boolean"), outputs=tuple(outputs))


def evaluation_report(run: DataFrame, qrels: DataFrame, names: list[str], collection_size: int, grade: int = 0, strip_prefix: bool = True, summarise: bool = False) -> DataFrame:
    """The evaluation command: topic prefixes up to ``_`` are stripped, measures are given per topic or as means with the number of topics."""
    held = run.withColumn("topic", F.element_at(F.split("topic", "_"), -1)) if strip_prefix else run
    known = ev.registry(collection_size, grade)
    per = ev.evaluate(ev.ranked(held), qrels, {n: known[n] for n in names})
    return ev.summary(per) if summarise else per


def with_queries(experiment: Experiment, queries: Mapping[str, Node]) -> Experiment:
    return replace(experiment, queries=queries)
