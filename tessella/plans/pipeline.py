"""Runs of several queries in stages, over one data set or many, with artifacts and reports.

A stage is a query whose result is written as Parquet under the run's folder; a stage whose artifact is there is skipped
unless it is forced. Reports read the small summary artifacts only.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from functools import reduce
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
STAGES = ["b18_violations", "o9_rows", "g1_class_summary", "g2_global", "g3_metric_win", "q1_audit", "q2_quality", "q4_difficulty", "q5_rows", "q3_queue", "q6_audit", "q9_manifest"]
SUMMARIES = ["g2_global", "g1_class_summary", "q2_quality", "q6_audit"]


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; each may be set by an environment variable of its name in capitals with the prefix TESSELLA_."""

    top_k: int = 5
    fetch_k: int = 30
    tie: float = 0.05
    resamples: int = 1000
    checkpoint_dir: str = ""

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        said = {f.name: env[k] for f in fields(cls) if (k := f"TESSELLA_{f.name.upper()}") in env}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{n: kinds[n](v) for n, v in said.items()})


def written(spark: SparkSession, path: str) -> bool:
    """Whether an artifact is complete."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_stages(spark: SparkSession, data: str, out: str, queries: dict[str, Query], stages: Iterable[str] = STAGES, skip: Iterable[str] = (), force: bool = False) -> dict[str, str]:
    """(stage -> done, reused, skipped or the error) of all stages in order; a failed stage does not stop those after it."""
    status = {}
    for name in stages:
        if name in skip or name not in queries:
            status[name] = "skipped"
        elif not force and written(spark, f"{out}/{name}"):
            status[name] = "reused"
        else:
            try:
                queries[name](spark, data).write.mode("overwrite").parquet(f"{out}/{name}")
                status[name] = "done"
            except Exception as e:
                status[name] = f"failed: {str(e).splitlines()[0][:200]}"
    return status


def run_datasets(spark: SparkSession, data: dict[str, str], out: str, queries: dict[str, Query], **options) -> dict[str, dict[str, str]]:
    """The stages over several data sets, each under its own folder."""
    return {name: run_stages(spark, folder, f"{out}/dataset_name={name}", queries, **options) for name, folder in data.items()}


def combined(spark: SparkSession, out: str, names: Iterable[str], stage: str) -> DataFrame:
    """One stage's results of several data sets with the data set's name; columns that one lacks are null, missing artifacts are left out."""
    parts = [spark.read.parquet(p).withColumn("dataset_name", F.lit(n)) for n in names if written(spark, p := f"{out}/dataset_name={n}/{stage}")]
    if not parts:
        return spark.createDataFrame([], "dataset_name string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cells(df: DataFrame, rows: int = 200) -> tuple[list[str], list[list[str]]]:
    """Columns and texts of the first rows of a summary, in order of its columns (a report shows a page, not a table of all rows)."""
    shown = df.orderBy(*df.columns).limit(rows).collect()
    return df.columns, [["" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x) for x in r] for r in shown]


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """A Markdown report of summary tables, bars escaped."""
    out = [f"# {title}"]
    for name, df in tables.items():
        head, rows = cells(df)
        line = lambda xs: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
        out += ["", f"## {name}", "", line(head), line(["---"] * len(head)), *map(line, rows)]
    return "\n".join(out) + "\n"


def page(title: str, tables: dict[str, DataFrame]) -> str:
    """A static HTML page of summary tables; a number column named like a rate has a bar."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><style>table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px}}meter{{width:6em}}</style><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        head, rows = cells(df)
        cell = lambda c, x: f"<td>{escape(x)}{f' <meter value={x}></meter>' if c.endswith(('rate', 'accuracy')) and x else ''}</td>"
        out.append(f"<h2>{escape(name)}</h2><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in head)}</tr>{''.join('<tr>' + ''.join(map(cell, head, r)) + '</tr>' for r in rows)}</table>")
    return "\n".join(out)


def report(spark: SparkSession, out: str, title: str = "Evaluation", names: Iterable[str] = SUMMARIES, html: bool = False) -> str:
    """The report of a run from its summary artifacts; missing ones are named as unavailable."""
    found = {n: spark.read.parquet(f"{out}/{n}") if written(spark, f"{out}/{n}") else spark.createDataFrame([("unavailable",)], "status string") for n in names}
    return page(title, found) if html else markdown(title, found)
