"""Every sink with its source: a table written to the shared folder and read again, which must give the table back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.ontology import class_properties, merged, patterns
from tessella.operators.providers import cache_of, extractive_answer, overlap_score, with_provider
from tessella.plans.vectors import typed
from tessella.plans.dialect import SparkDialect
from tessella.session import shared_path, table
from tessella.sources import files

QUESTIONS = ["id", "question", "ground_truth", "contexts"]
# A small ontology of the domain.
ONTOLOGY = """
@prefix : <http://example.org/site#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:Device a owl:Class . :Panel a owl:Class . :Site a owl:Class .
:connectedTo a owl:ObjectProperty ; rdfs:domain :Device ; rdfs:range :Panel , :Device .
:locatedIn a owl:ObjectProperty ; rdfs:domain :Device , :Panel ; rdfs:range :Site .
:hasName a owl:DatatypeProperty ; rdfs:domain :Device .
:ratedPower a owl:DatatypeProperty ; rdfs:domain :Device ; rdfs:label "rated power"@en .
"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "autoq_questions").select(*QUESTIONS).distinct()


def a5_csv(spark: SparkSession, d: str) -> DataFrame:
    """Questions through CSV: line ends, quotes and delimiters in cells come back; nulls come back as empty texts."""
    path = shared_path(spark, "csv")
    files.write_csv(_questions(spark, d), path, QUESTIONS)
    back = files.read_csv(spark, path, ", ".join(f"{c} string" for c in QUESTIONS))
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in QUESTIONS])


def a7_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Questions through JSON lines."""
    path = shared_path(spark, "json")
    files.write_json_lines(_questions(spark, d), path)
    return files.read_json(spark, path, ", ".join(f"{c} string" for c in QUESTIONS))


def a8_graphml(spark: SparkSession, d: str) -> DataFrame:
    """Edges through GraphML."""
    edges = spark.sql(f"with {typed(SparkDialect(d, spark))} select src, dst from edges where rel <> 'supplied_by'")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    path = shared_path(spark, "graphml")
    files.graphml(nodes, edges).write.text(path)
    return files.read_graphml(spark, path)


def a10_records(spark: SparkSession, d: str) -> DataFrame:
    """Records through the record store, partitioned by type."""
    path = shared_path(spark, "records")
    table(spark, d, "product_records").select("record_id", "record_type", "product_name", "field_name", "field_value").distinct().write.partitionBy("record_type").parquet(path)
    return spark.read.parquet(path).select("record_id", F.col("record_type").cast("string"), "product_name", "field_name", "field_value")


def a11_optional(spark: SparkSession, d: str) -> DataFrame:
    """A manual review that is not there: an empty table of its schema, joined to the questions."""
    review = files.read_optional(spark, f"{shared_path(spark, 'none')}/review.csv", "id string, verdict string, notes string").withColumnRenamed("notes", "review_notes")
    return _questions(spark, d).select("id").distinct().join(review, "id", "left").select("id", "verdict", "review_notes")


def a16_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through the vector store."""
    path = shared_path(spark, "vectors")
    table(spark, d, "embeddings").write.parquet(path)
    return spark.read.parquet(path).select("vec_id", "label", F.size("embedding").cast("bigint").alias("n"))


def a18_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Products as lines of a Markdown table."""
    return files.markdown_rows(table(spark, d, "products").select("product_name", "product_kind"))


def a1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents through a folder tree of text files, one folder a language."""
    path = shared_path(spark, "texts")
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.concat("doc_id", F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("value"))
    docs.write.partitionBy("lang").text(path)
    lines = files.read_texts(spark, path).select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("lang").agg(F.count("*").alias("documents"))


def a19_files(spark: SparkSession, d: str) -> DataFrame:
    """Digests of files: one file of known content."""
    path = shared_path(spark, "digest")
    spark.createDataFrame([("tessella",)], "value string").coalesce(1).write.text(path)
    return files.digests(spark, path).where(F.col("path").contains("part-")).select("sha256")


def b31_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the classes of an ontology merged from two texts, one of which is broken."""
    c = class_properties(merged(spark, [ONTOLOGY, "@prefix broken"]))
    return c.select("class", F.array_join("properties", "|").alias("properties"))


def b30_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of the object properties of a merged ontology."""
    return patterns(merged(spark, [ONTOLOGY, ONTOLOGY, "no turtle"]))


def e3_cache(spark: SparkSession, d: str) -> DataFrame:
    """Scores by provider with a cache: what the first run computed is reused, only other texts are computed; as counts."""
    q = table(spark, d, "autoq_questions").where("question is not null").select("question").distinct()
    length = lambda c: F.length(c).cast("bigint")
    first = with_provider(q.where(F.length("question") % 2 == 0), "question", "n", length)
    second = with_provider(q, "question", "n", length, cache_of(first, "question", "n"))
    return second.agg(F.count("*").alias("rows"), F.sum("n").alias("total"))


def s2_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of every question with its truth by the reranking provider."""
    return _questions(spark, d).select("id", "question", "ground_truth").distinct().select("id", overlap_score(F.col("question"), F.col("ground_truth")).alias("score"))


def s3_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to every question from its contexts by the answering provider."""
    return _questions(spark, d).where("question is not null").select("id", extractive_answer(F.col("question"), F.col("contexts")).alias("answer"))


QUERIES = {f.__name__: f for f in (a1_texts, a5_csv, a7_json_lines, a8_graphml, a10_records, a11_optional, a16_vectors, a18_markdown, a19_files, b30_patterns, b31_properties, e3_cache, s2_rerank, s3_answers)}

_Q = "select distinct " + ", ".join(QUESTIONS) + " from autoq_questions"
ORACLES = {
    "a1_texts": "select coalesce(lang, 'none') as lang, count(*) as documents from documents group by 1",
    "a5_csv": "select " + ", ".join(f"coalesce({c}, '') as {c}" for c in QUESTIONS) + f" from ({_Q}) q",
    "a7_json_lines": _Q,
    "a8_graphml": "select concat('supplier:', s_suppkey) as src, concat('nation:', s_nationkey) as dst from supplier union all select concat('customer:', c_custkey), concat('nation:', c_nationkey) from customer union all select concat('nation:', n_nationkey), concat('region:', n_regionkey) from nation",
    "a10_records": "select distinct record_id, record_type, product_name, field_name, field_value from product_records",
    "a11_optional": "select distinct id, cast(null as varchar) as verdict, cast(null as varchar) as review_notes from autoq_questions where id is not null",
    "a16_vectors": "select vec_id, label, len(embedding) as n from embeddings",
    "a18_markdown": "select concat('| ', replace(coalesce(product_name, ''), '|', '\\|'), ' | ', replace(coalesce(product_kind, ''), '|', '\\|'), ' |') as value from products",
    "a19_files": "select sha256(concat('tessella', chr(10))) as sha256",
    "b30_patterns": "select * from (values ('Device', 'connectedTo', 'Panel'), ('Device', 'connectedTo', 'Device'), ('Device', 'locatedIn', 'Site'), ('Panel', 'locatedIn', 'Site')) t(domain, property, range)",
    "b31_properties": "select * from (values ('Device', 'name|ratedPower'), ('Panel', 'name'), ('Site', 'name')) t(class, properties)",
    "e3_cache": "select count(*) as rows, cast(sum(length(question)) as bigint) as total from (select distinct question from autoq_questions where question is not null) q",
    "s2_rerank": "select distinct id, cast(len(list_filter(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(question, '')), '[^a-z0-9]+'), lambda w: length(w) > 2)), lambda w: contains(lower(coalesce(ground_truth, '')), w))) as double) as score from (select distinct id, question, ground_truth from autoq_questions) q",
}
