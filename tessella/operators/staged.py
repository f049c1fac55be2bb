"""Staged hybrid retrieval: similarity and diversity by vectors, lexical search, preferences, reranking, final score.

The three searches run over the whole corpus as operators; what they leave is bounded by their k, and the later stages
work on that list, one question at a time. Metadata filter: a question that asks for a type of document searches
only that type. Embedding and reranking are providers; the defaults are hashed word counts and the keyword score.

Defined results: a question without any candidate has no row; ties keep the order of the stages (diversity, similarity,
lexical), then the smaller chunk id; null questions are left out; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.lexical import Question, keyword_score, search
from tessella.operators.providers import hashed_embedding
from tessella.operators.vectors import mmr, nearest
from tessella.session import keep

TOP, FETCH = 5, 30
EXACT = ("single_numeric_spec", "enumerated_settings", "capacity")  # types of questions that look for a value
# Weights of the final score and boosts.
SIMILARITY, LEXICAL, KEYWORD, TYPE = 1.0, 0.35, 1.8, 1.5
SECTION = 2.0
SCHEMA = "id string, place bigint, chunk_id string, score double, sources string"

Rerank = Callable[[Question, str], float]


def asked_type(question: Column) -> Column:
    """The type of document a question asks for, or an empty text."""
    q = F.lower(question)
    return F.when(q.contains("install") | q.contains("how to"), "installation").when(q.contains("spec") | q.contains("rating") | q.contains("voltage"), "datasheet").otherwise("")


def section_boost(kind: str, header: str, block: str) -> float:
    if kind == "single_numeric_spec":
        return SECTION * (block == "specification" or "spec" in header)
    if kind == "enumerated_settings":
        return SECTION * (block in ("specification", "features") or "feature" in header or "electrical" in header)
    return SECTION * (kind == "procedure" and block == "procedure")


def final_score(q: Question, wanted: str, row: dict) -> float:
    """Similarity, lexical and keyword score and boosts of one candidate."""
    return SIMILARITY * row["sim"] + LEXICAL * row["lexical"] + KEYWORD * keyword_score(q, row["text"].lower()) + TYPE * (wanted != "" and row["doc_type"] == wanted) + section_boost(q.kind, row["header"], row["block"])


def choose(question: str, wanted: str, rows: list[dict], top: int = TOP, rerank: Rerank | None = None) -> list[dict]:
    """The stages after the searches. rows: candidates in order of priority, with text, header, block, doc, doc_type, sim (0 if unknown), lexical (0 if not found lexically), lexical_rank and sim_rank (null if not found so)."""
    q = Question.of(question)
    top = max(top, 5) if q.products or q.phrases or q.kind in EXACT else top
    score = rerank or (lambda q, text: keyword_score(q, text.lower()))
    merged = rows
    if q.products:
        own = [r for r in merged if any(p in r["text"].lower() or p in r["doc"] for p in q.products)]
        merged = own or merged
    if q.phrases:
        first = [r for r in merged if any(p in r["text"].lower() for p in q.phrases)]
        merged = first + [r for r in merged if r not in first]
    limit = max(top * 5, 20) if q.products or q.phrases else max(top * 3, 10)
    ranked = sorted(merged, key=lambda r: -score(q, r["text"]))[:limit]
    kept = sorted([r for r in rows if r["lexical_rank"]], key=lambda r: r["lexical_rank"])[: max(2 * top, 6)]
    pool = kept + [r for r in ranked if r not in kept]
    best = sorted(pool, key=lambda r: -final_score(q, wanted, r))
    if not best or wanted and all(r["doc_type"] != wanted for r in best[:3]):
        near = sorted([r for r in rows if r["sim_rank"]], key=lambda r: r["sim_rank"])[:top]
        best = near + [r for r in best if r not in near]
    return [r | {"score": final_score(q, wanted, r)} for r in best[:top]]


def staged(questions: DataFrame, chunks: DataFrame, top: int = TOP, fetch: int = FETCH, embed: Callable[[Column], Column] = hashed_embedding, rerank: Rerank | None = None) -> DataFrame:
    """(id, place, chunk_id, score, sources) of the best chunks of every question (id, question). chunks: chunk_id, text, header, block, doc, doc_type."""
    asked = keep(questions.where("id is not null and question is not null").select("id", "question", asked_type(F.col("question")).alias("wanted"), F.xxhash64(F.lit("q"), "id").alias("vec_id")).withColumn("embedding", embed(F.col("question"))))
    held = keep(chunks.where("text is not null").withColumn("vec_id", F.xxhash64(F.lit("c"), "chunk_id")).withColumn("embedding", embed(F.col("text"))))
    found: DataFrame | None = None
    for wanted in ("", "installation", "datasheet"):
        q, c = asked.where(F.col("wanted") == wanted), held.where(F.col("doc_type") == wanted) if wanted else held
        one = lambda df, source, place, sim: df.select("query_id", "vec_id", F.lit(source).alias("source"), F.col(place).cast("bigint").alias("rank"), sim.alias("sim"), F.lit(0.0).alias("lexical"))
        near = one(nearest(q, c, fetch), "similarity", "rank", F.col("sim"))
        apart = one(mmr(q, c, max(3 * top, 15), fetch), "diversity", "pos", F.lit(None).cast("double"))
        lex = search(q, c, max(6 * top, 25)).select(F.xxhash64(F.lit("q"), "id").alias("query_id"), F.xxhash64(F.lit("c"), "chunk_id").alias("vec_id"), F.lit("lexical").alias("source"), F.col("rank").cast("bigint").alias("rank"), F.lit(None).cast("double").alias("sim"), "lexical")
        part = near.unionByName(apart).unionByName(lex)
        found = part if found is None else found.unionByName(part)
    rank = lambda s: F.min(F.when(F.col("source") == s, F.col("rank")))
    order = F.when(F.col("source") == "diversity", 0).when(F.col("source") == "similarity", 1).otherwise(2) * 1000 + F.col("rank")
    merged = found.groupBy("query_id", "vec_id").agg(F.min(order).alias("priority"), F.coalesce(F.max("sim"), F.lit(0.0)).alias("sim"), F.max("lexical").alias("lexical"), rank("similarity").alias("sim_rank"), rank("lexical").alias("lexical_rank"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
    texts = held.select("vec_id", "chunk_id", "text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("header", "block", "doc", "doc_type")])
    lists = merged.join(texts, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), "id", "question", "wanted"), "query_id")

    def stages(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "chunk_id"])
        ranks = pdf[["sim_rank", "lexical_rank"]].astype(object).where(pdf[["sim_rank", "lexical_rank"]].notna(), None)
        rows = (pdf.drop(columns=["sim_rank", "lexical_rank"]).join(ranks)).to_dict("records")
        best = choose(pdf["question"].iloc[0], pdf["wanted"].iloc[0], rows, top, rerank)
        return pd.DataFrame([(r["id"], i, r["chunk_id"], round(r["score"], 6), r["sources"]) for i, r in enumerate(best, 1)], columns=["id", "place", "chunk_id", "score", "sources"])

    return lists.groupBy("query_id").applyInPandas(stages, SCHEMA)
