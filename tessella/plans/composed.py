"""Compositions of operators: graph retrieval for questions, vector search with graph expansion, batch answers, line repair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.answers import cleaned, repaired_lines, section_block
from tessella.operators.graph import within
from tessella.operators.lexical import search
from tessella.operators.providers import Providers, hashed_embedding
from tessella.operators.vectors import nearest
from tessella.plans.dialect import Dialect, SparkDialect, both
from tessella.plans.retrieve import QUERIES_OF, _chunks, _questions
from tessella.plans.texts import docs, entities, l1_cooc
from tessella.session import keep, spread

HOPS = 2


def asked_entities(q: Dialect) -> str:
    """CTE qe: the entities of the questions of the query set, and CTE ae: those of their answers."""
    base = f"(select id, min(question) as question, min(coalesce(ground_truth, '')) as truth from {q.t('autoq_questions')} where try_cast(id as bigint) % {QUERIES_OF} = 0 and question is not null group by id)"
    one = lambda c: f"select id, {q.explode('es')} as entity from (select id, {entities(q, c)} as es from {base} b) x"
    return f"qe as ({one('question')}), ae as ({one('truth')})"


def k25_graph(spark: SparkSession, d: str) -> DataFrame:
    """Graph retrieval: entities of the question, their nodes in the co-occurrence graph, all nodes within two hops, and the least hops to an entity of the answer (null beyond)."""
    q = SparkDialect(d, spark)
    edges = spark.sql(f"select src, dst from ({l1_cooc(q)}) e")
    asked = spark.sql(f"with {asked_entities(q)} select id, entity as node from qe")
    wanted = spark.sql(f"with {asked_entities(q)} select id, entity as node from ae")
    return within(edges, asked, wanted, HOPS).select("id", "nodes", "hops", F.col("hops").isNotNull().alias("reachable"))


def k11_expand(spark: SparkSession, d: str) -> DataFrame:
    """Vector search for the query set by the embedding provider, the five nearest documents, expanded to the products they name."""
    asked = _questions(spark, d, QUERIES_OF).select(F.xxhash64(F.lit("q"), "id").alias("vec_id"), "id", hashed_embedding(F.col("question")).alias("embedding"))
    held = spread(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("vec_id"), "product_name", hashed_embedding(F.col("text")).alias("embedding"))
    near = nearest(asked, held, 5).join(held.select("vec_id", "product_name"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), "id"), "query_id")
    return near.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("product_name")), "|").alias("products"), F.max("sim").alias("sim"))


def s21_predictions(spark: SparkSession, d: str, providers: Providers = Providers(), run_id: str = "local") -> DataFrame:
    """Batch predictions: for every question of the query set the five best sections, cut to 1200 characters (the cut is the feature), and the answer from them by the provider."""
    asked, chunks = _questions(spark, d, QUERIES_OF), keep(_chunks(spark, d))
    best = search(asked, chunks, 5).join(chunks.select("chunk_id", F.substring("text", 1, 1200).alias("text")), "chunk_id")
    lists = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("c"))
    joined = asked.join(lists, "id", "left").withColumn("context", F.array_join(F.col("c.text"), "\n"))
    return joined.select("id", providers.answer(F.col("question"), F.col("context")).alias("answer"), F.to_json(F.col("c.text")).alias("retrieved_contexts"), F.lit(run_id).alias("run_id"))


def _by_line(build: Callable[[str], list[str]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(i, k, x) for i, t in zip(b["doc_id"], b["text"]) if t for k, x in enumerate(build(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "pos", "line"])

        return spread(spark, d, "documents").select("doc_id", "text").mapInPandas(lines, "doc_id bigint, pos bigint, line string")

    return run


def _first_block(text: str) -> list[str]:
    return section_block([x for x in text.split("\n") if x.strip()], 0, "specifications") if text.strip() else []


c15_repair = _by_line(repaired_lines)
c17_clean = _by_line(lambda t: cleaned(t).split("\n"))
d10_blocks = _by_line(_first_block)


def a9_relations(q: Dialect) -> str:
    """All typed relations between named nodes that are no infrastructure, in order: a scan of a graph store."""
    return f"select distinct product_name as src, field_name as rel, field_value as dst from {q.t('product_records')} where product_name is not null and field_name is not null and field_value is not null and coalesce(record_type, '') not in ('chunk', 'document') order by src, rel, dst"


def c45_union(q: Dialect) -> str:
    """Values appended to a list only where they are not in it."""
    a, b = q.find("lower(question)", "[a-z]+"), q.find("lower(coalesce(ground_truth, ''))", "[a-z]+")
    joined = f"array_union({a}, {b})" if q.spark else q.distinct(q.cat(a, b))
    return f"select distinct id, {q.size(joined)} as n, {q.join(q.sort(joined), ' ')} as words from {q.t('autoq_questions')} where question is not null"


def e11_best(q: Dialect) -> str:
    """The best entity of a product text: an equal catalogue name first, else the shortest that holds it or is held, else the text in canonical form."""
    pick = "min_by" if q.spark else "arg_min"
    held = f"(select id, trim(p) as part from (select id, {q.explode(q.split('source_product', '[|;]'))} as p from (select distinct id, source_product from {q.t('autoq_questions')} where source_product is not null) s) x where trim(p) <> '')"
    names = f"(select distinct product_name, lower(product_name) as low_n from {q.t('products')})"
    return f"""with h as (select distinct id, part, lower(part) as low_p from {held} h0), m as (select h.id, h.part, n.product_name, case when n.low_n = h.low_p then 0 else 1 end as level from h join {names} n on n.low_n = h.low_p),
    b as (select id, part, {pick}(product_name, level) as best from m group by id, part) select h.id, h.part, coalesce(b.best, h.low_p) as entity from h left join b on h.id = b.id and h.part = b.part"""


def l20_sources(q: Dialect) -> str:
    """How often each entity can be the source of a relation: products and components of a text, each once."""
    from tessella.plans.texts import extracted

    x = extracted(q, "text")
    return f"select source, count(*) as n from (select doc_id, {q.explode(q.distinct(q.cat(x['products'], x['components'])))} as source from {docs(q)} d) s group by source"


DUAL = [a9_relations, c45_union, e11_best, l20_sources]
QUERIES, ORACLES = both({f.__name__: f for f in DUAL})
QUERIES |= {"k11_expand": k11_expand, "k25_graph": k25_graph, "s21_predictions": s21_predictions, "c15_repair": c15_repair, "c17_clean": c17_clean, "d10_blocks": d10_blocks}
_D = Dialect()
ORACLES |= {
    "k25_graph": f"""with recursive {asked_entities(_D)}, e as (select src, dst from ({l1_cooc(_D)}) z), u as (select src, dst from e union select dst, src from e), starts as (select distinct entity from qe where entity in (select src from u)),
    walk as (select entity as start, entity as node, 0 as hops from starts union select w.start, u.dst, w.hops + 1 from walk w join u on w.node = u.src where w.hops < {HOPS}),
    f as (select qe.id, w.node, min(w.hops) as hops from qe join walk w on qe.entity = w.start group by qe.id, w.node), h as (select f.id, cast(min(f.hops) as bigint) as hops from f join ae on f.id = ae.id and f.node = ae.entity group by f.id), n as (select id, count(*) as nodes from f group by id)
    select n.id, n.nodes, h.hops, h.hops is not null as reachable from n left join h on n.id = h.id""",
}
