"""Sources and sinks: folders of texts, CSV, JSON and JSON lines, GraphML, Markdown tables; all by Spark's own readers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_texts(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """(path, text): every file of a folder tree, whole; invalid UTF-8 becomes the replacement character."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of every file of a folder tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header, line breaks in quotes and doubled quotes; all strings unless a schema is given."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_optional(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """The table of a path, or an empty one of the schema where there is none."""
    if not Path(path).exists():
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema) if kind == "csv" else spark.read.schema(schema).json(path, multiLine=kind == "json")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True) -> DataFrame:
    """JSON lines (blank lines skipped) or one JSON array."""
    return spark.read.json(path, schema=schema, multiLine=not lines)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with the columns in order of name."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a fixed column list; missing columns and nulls are empty."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): the body lines of a GraphML document, nodes before edges."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    n = nodes.select(F.lit(0).alias("k"), F.format_string('<node id="%s"/>', esc("node")).alias("value"))
    e = edges.select(F.lit(1).alias("k"), F.format_string('<edge source="%s" target="%s"/>', esc("src"), esc("dst")).alias("value"))
    return n.unionByName(e).orderBy("k", "value").select("value")


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of the edges of GraphML text files, one element a line."""
    lines = spark.read.text(path)
    return lines.where(F.col("value").contains("<edge")).select(F.regexp_extract("value", 'source="([^"]*)"', 1).alias("src"), F.regexp_extract("value", 'target="([^"]*)"', 1).alias("dst"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """(value): every row as a line of a Markdown table, bars escaped."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\\\|") for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def strip_tags(html: Column) -> Column:
    """The text of an HTML page: scripts, styles and tags removed, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
