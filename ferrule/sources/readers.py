"""Readers of the text formats of retrieval experiments. All are lazy scans; a line that does not fit its format is null in the fields it lacks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.plans.ast import MESH_FIELDS, ABSTRACT, TITLE, Boolean, Keyword, Node
from ferrule.plans.parsers import PARSERS, parse_medline, parse_pubmed


def _columns(spark: SparkSession, path: str, names: list[tuple[str, str]], separator: str = r"\s+") -> DataFrame:
    parts = F.split(F.trim("value"), separator)
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(parts.alias("parts")).select(*[F.expr(f"try_cast(get(parts, {i}) AS {kind})").alias(n) for i, (n, kind) in enumerate(names)])


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """TREC run lines: topic iteration doc_id rank score run_name."""
    return _columns(spark, path, [("topic", "string"), ("iteration", "string"), ("doc_id", "string"), ("rank", "bigint"), ("score", "double"), ("run_name", "string")])


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """TREC relevance judgements: topic iteration doc_id score."""
    return _columns(spark, path, [("topic", "string"), ("iteration", "string"), ("doc_id", "string"), ("score", "bigint")])


def qrels_of(qrels: DataFrame, topic: str) -> DataFrame:
    """The judgements of one topic, as a pushed-down filter."""
    return qrels.where(F.col("topic") == topic)


def read_pmids(spark: SparkSession, path: str) -> DataFrame:
    """One document number a line."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) AS bigint)").alias("doc_id")).where("doc_id IS NOT NULL")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, text): one file per topic, named after it."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("topic"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))


def read_keyword_queries(spark: SparkSession, path: str, fields: tuple[str, ...] = (TITLE, ABSTRACT)) -> DataFrame:
    """(topic, query_string, fields): each file is one keyword with fixed fields."""
    return read_topics(spark, path).select("topic", F.col("text").alias("query_string"), F.array(*map(F.lit, fields)).alias("fields"))


def read_semantic_types(spark: SparkSession, path: str) -> DataFrame:
    """(semantic_type, abbreviation): columns 1 and 4 of a pipe-separated file."""
    raw = spark.read.csv(path, sep="|", schema="a string, b string, c string, d string", quote="", mode="PERMISSIVE")
    return raw.select(F.col("a").alias("semantic_type"), F.col("d").alias("abbreviation"))


def read_date_restrictions(spark: SparkSession, path: str) -> DataFrame:
    """(topic, start, end) of tab-separated yyyyMMdd dates."""
    raw = spark.read.csv(path, sep="\t", schema="topic string, s string, e string")
    return raw.select(F.trim("topic").alias("topic"), F.expr("try_to_date(trim(s), 'yyyyMMdd')").alias("start"), F.expr("try_to_date(trim(e), 'yyyyMMdd')").alias("end"))


PROTOCOL_FIELDS = ["objective", "type_of_study", "participants", "index_tests", "target_conditions", "reference_standards"]


def read_protocols(spark: SparkSession, path: str, row_tag: str = "root") -> DataFrame:
    """(topic, six sections) of XML protocols, one file per topic."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in PROTOCOL_FIELDS])
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.xml$", "").alias("topic"), *PROTOCOL_FIELDS)


def _feature_map(c: str):
    pairs = F.filter(F.split(F.trim(c), r"\s+"), lambda p: p.contains(":"))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int").alias("key"), F.split_part(p, F.lit(":"), F.lit(2)).cast("double").alias("value"))))


def read_libsvm_rank(spark: SparkSession, path: str) -> DataFrame:
    """(topic, score, features, comment) of lines ``score qid:topic id:value ... # comment``."""
    body, comment = F.split_part("value", F.lit("#"), F.lit(1)), F.trim(F.split_part("value", F.lit("#"), F.lit(2)))
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(body.alias("b"), comment.alias("comment"))
    found = lambda p: F.regexp_extract("b", p, 1)
    return lines.select(found(r"qid:(\S+)").alias("topic"), F.expr("try_cast(regexp_extract(b, '^\\\\s*(\\\\S+)', 1) AS double)").alias("score"), F.regexp_replace("b", r"^\s*\S+|qid:\S+", "").alias("f"), "comment").select(
        "topic", "score", _feature_map("f").alias("features"), "comment"
    )


def read_reinforcement(spark: SparkSession, path: str) -> DataFrame:
    """(topic, scores, features, comment) of lines ``topic * s1 s2 ... * id:value ... # comment``."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    part = lambda i: F.trim(F.split_part(F.split_part("value", F.lit("#"), F.lit(1)), F.lit("*"), F.lit(i)))
    return lines.select(part(1).alias("topic"), F.transform(F.filter(F.split(part(2), r"\s+"), lambda s: s != ""), lambda s: s.cast("double")).alias("scores"), part(3).alias("f"), F.trim(F.split_part("value", F.lit("#"), F.lit(2))).alias("comment")).select(
        "topic", "scores", _feature_map("f").alias("features"), "comment"
    )


@dataclass(frozen=True)
class ExtractionScript:
    pmids: tuple[int, ...]
    field: str
    statistic: dict = field(default_factory=dict)


def parse_extraction_script(text: str) -> ExtractionScript:
    raw = json.loads(text)
    return ExtractionScript(tuple(int(p) for p in raw.get("pmids") or ()), raw.get("field", "title"), raw.get("statistic") or {})


def extract(docs: DataFrame, script: ExtractionScript) -> DataFrame:
    """(doc_id, value): the named field of all listed documents."""
    column = {"title": "ti", "abstract": "ab"}.get(script.field, script.field)
    wanted = docs.sparkSession.createDataFrame([(p,) for p in script.pmids], "doc_id long")
    return docs.join(wanted, "doc_id", "left_semi").select("doc_id", F.col(column).alias("value"))


def fetch_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ``ids``, each once."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi")


def population_sample(docs: DataFrame, start: str | None = None, end: str | None = None, limit: int = 10_000) -> DataFrame:
    """At most ``limit`` documents, smallest ids first, of a date range; the limit is the operator's definition of a population."""
    held = docs
    if start:
        held = held.where(F.col("dcom") >= F.lit(start).cast("date"))
    if end:
        held = held.where(F.col("dcom") <= F.lit(end).cast("date"))
    return held.orderBy("doc_id").limit(limit)


# Query files: texts are parsed where they are read, one row per file.


def read_queries(spark: SparkSession, path: str, parser: str = "medline") -> DataFrame:
    """(topic, query, error): the files of a folder parsed to JSON trees. A text that cannot be parsed has a null query and the reason."""
    return parse_column(read_topics(spark, path), "topic", "text", parser)


def parse_column(df: DataFrame, key: str, text: str, parser: str = "expression") -> DataFrame:
    """(key, query, error) with the text column parsed in Arrow batches."""
    from ferrule.plans.ast import to_json

    read = PARSERS[parser]
    kind = df.select(key).schema.simpleString()[7:-1]

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf["__t"]:
                try:
                    out.append((to_json(read(t)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield pdf[[key]].assign(query=[a for a, _ in out], error=[b for _, b in out])

    return df.select(key, F.col(text).alias("__t")).mapInPandas(run, f"{kind}, query string, error string")


_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})


@dataclass(frozen=True)
class TarTopic:
    topic: str
    title: str
    query: Node
    original: str


def parse_tar_topic(text: str) -> TarTopic:
    """A topic file of blocks ``Topic:``, ``Title:``, ``Query:`` (and ``Pids:``, which is not read). Fewer than 3 query lines are PubMed notation, else Ovid."""
    blocks: dict[str, list[str]] = {}
    name = ""
    for line in text.translate(_QUOTES).splitlines():
        if found := re.match(r"(Topic|Title|Query|Pids):\s*(.*)$", line):
            name = found[1]
            blocks[name] = [found[2]] if found[2].strip() else []
        elif line.strip() and name:
            blocks[name].append(line.rstrip())
    lines = blocks.get("Query", [])
    original = "\n".join(lines)
    return TarTopic(" ".join(blocks.get("Topic", [])).strip(), " ".join(blocks.get("Title", [])).strip(), parse_pubmed(original) if len(lines) < 3 else parse_medline(original), original)


def read_tar_topics(spark: SparkSession, folder: str) -> DataFrame:
    """(topic, title, original, query, simplified, error): the topic files of a folder, one row per file, trees as JSON. A file that cannot be read has the reason."""
    from ferrule.plans.ast import to_json

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["value"]:
                try:
                    t = parse_tar_topic(text)
                    simple = simplify_original(t.query)
                    out.append((t.topic, t.title, t.original, to_json(t.query), None if simple is None else to_json(simple), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, None, text, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["topic", "title", "original", "query", "simplified", "error"])

    import pandas as pd

    return spark.read.text(folder, wholetext=True).mapInPandas(run, "topic string, title string, original string, query string, simplified string, error string")


def load_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The queries that ``writers.save_queries`` wrote: parsing is done once."""
    return spark.read.parquet(folder)


def simplify_original(node: Node) -> Node | None:
    """Keywords of only a MeSH field go; those of one other field stay; those of several become title and abstract. Empty groups go with them."""
    if isinstance(node, Keyword):
        if len(node.fields) == 1:
            return None if node.fields[0] in MESH_FIELDS else node
        return Keyword(node.text, (TITLE, ABSTRACT), node.exploded, node.truncated, node.options)
    kept = tuple(c for c in map(simplify_original, node.children) if c is not None)
    return Boolean(node.operator, kept) if kept else None
