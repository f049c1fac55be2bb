"""Similarity of vectors, and the property graph of parts, suppliers, customers and nations, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.vectors import mmr, nearest, similar
from tessella.plans.dialect import Dialect, both
from tessella.session import table

QUERIES_OF = 20  # every id divisible by it is a query of a search
LEAST = 0.3  # cosine of a similarity edge


def unit(q: Dialect, name: str) -> str:
    """Vectors with their norms; a vector of norm 0 has similarity 0."""
    return f"{name} as (select vec_id, label, embedding as v, sqrt({q.dot('embedding', 'embedding')}) as norm from {q.t('embeddings')})"


def cosine(q: Dialect) -> str:
    return f"case when a.norm = 0 or b.norm = 0 then 0.0 else {q.dot('a.v', 'b.v')} / (a.norm * b.norm) end"


def k1_knn(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every query vector, over all vectors."""
    v = table(spark, d, "embeddings")
    return nearest(v.where(F.col("vec_id") % QUERIES_OF == 0), v, 5).select("query_id", "vec_id", "sim", F.col("rank").alias("k"))


def k1_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of label 3 of every query vector: the filter comes before the search."""
    v = table(spark, d, "embeddings")
    return nearest(v.where(F.col("vec_id") % QUERIES_OF == 0), v.where("label = 3"), 3).select("query_id", "vec_id", "sim", F.col("rank").alias("k"))


def f12_sim_join(spark: SparkSession, d: str) -> DataFrame:
    """All similarity edges between the two corpora, the vectors of even and of odd ids."""
    v = table(spark, d, "embeddings")
    return similar(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), LEAST)


def k13_edges(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean and greatest weight of the similarity edges by source."""
    e = f12_sim_join(spark, d)
    return e.groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("weight") + 1e-9, 4).alias("mean"), F.max("weight").alias("most"))


def k2_mmr(spark: SparkSession, d: str) -> DataFrame:
    """Maximal marginal relevance for every query vector."""
    v = table(spark, d, "embeddings")
    return mmr(v.where(F.col("vec_id") % QUERIES_OF == 0), v)


def m2_web(spark: SparkSession, d: str) -> DataFrame:
    """Web evidence: for every edge of a part and a supplier, the web vectors (odd ids) similar to the user vector its part stands for, with confidence 0.6 times the similarity."""
    sims = f12_sim_join(spark, d)
    spans = table(spark, d, "embeddings").agg(F.max("vec_id").alias("top"))
    edges = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    named = edges.withColumn("user", F.pmod("l_partkey", F.floor(spans.scalar() / 2) + 1) * 2)
    found = named.join(sims, named["user"] == sims["src"])
    return found.select("l_partkey", "l_suppkey", F.col("dst").alias("web"), F.round(F.lit(0.6) * F.col("weight"), 3).alias("confidence"))


def typed(q: Dialect) -> str:
    """Typed edges: part supplied by supplier, supplier and customer located in nation, nation part of region."""
    return f"""edges as (select distinct concat('part:', l_partkey) as src, concat('supplier:', l_suppkey) as dst, 'supplied_by' as rel from {q.t("lineitem")}
    union all select concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'located_in' from {q.t("supplier")}
    union all select concat('customer:', c_custkey), concat('nation:', c_nationkey), 'located_in' from {q.t("customer")}
    union all select concat('nation:', n_nationkey), concat('region:', n_regionkey), 'part_of' from {q.t("nation")})"""


def l7_degrees(q: Dialect) -> str:
    """Nodes, edges and mean degree."""
    return f"with {typed(q)}, n as (select src as node from edges union select dst from edges) select (select count(*) from n) as nodes, (select count(*) from edges) as edge_count, round(2.0 * (select count(*) from edges) / (select count(*) from n), 4) as mean_degree"


def l8_counts(q: Dialect) -> str:
    return f"with {typed(q)} select rel, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from edges group by rel"


def l9_expand(q: Dialect) -> str:
    """One and two hops from every twentieth part: edges of at least the least weight and confidence; those of the second hop are products.

    Missing weights and confidences count as 1 in the filter; a second hop never leads back."""
    return f"""with w as (select concat('part:', l_partkey) as src, concat('supplier:', l_suppkey) as dst, 'supplied_by' as rel, cast(count(*) as double) as weight, max(l_discount) * 10 as confidence from {q.t("lineitem")} where l_partkey % {QUERIES_OF} = 0 group by l_partkey, l_suppkey),
    b as (select concat('supplier:', s_suppkey) as src, concat('nation:', s_nationkey) as dst, 'located_in' as rel, cast(0.5 as double) as weight, cast(null as double) as confidence from {q.t("supplier")}),
    hop1 as (select * from w where coalesce(weight, 1) >= 1 and coalesce(confidence, 1) >= 0.2)
    select a.src, a.rel as rel1, a.dst as hop1, b.rel as rel2, b.dst as hop2, round(a.weight * coalesce(b.weight, 1), 3) as weight, round(coalesce(a.confidence, 1) * coalesce(b.confidence, 1), 3) as confidence
    from hop1 a left join b on a.dst = b.src and b.dst <> a.src and coalesce(b.weight, 1) >= 0.1"""


def l10_weights(q: Dialect) -> str:
    """Edge weights by shared orders, scaled with a floor of 0.1; the greatest is one row, not a window over all."""
    s = f"select l_partkey, l_suppkey, count(distinct l_orderkey) as shared from {q.t('lineitem')} group by l_partkey, l_suppkey"
    return f"with s as ({s}) select l_partkey, l_suppkey, round(cast(0.1 as double) + cast(0.9 as double) * shared / (select max(shared) from s), 4) as weight from s"


def l13_orphans(q: Dialect) -> str:
    """Customers without any order: nodes without relation, but for every third customer, whose orders are left out so that there are some."""
    return f"select c_custkey from {q.t('customer')} c {'left anti' if q.spark else 'anti'} join (select o_custkey from {q.t('orders')} where o_custkey % 3 <> 0) o on c.c_custkey = o.o_custkey"


def m1_evidence(q: Dialect) -> str:
    """Evidence of part and supplier: one row per order with confidence 0.8; suppliers without order one inferred row of 0.5."""
    return f"""select concat('supplier:', s.s_suppkey) as src, case when l.l_orderkey is null then 'inference' else 'document' end as source_type, count(*) as n, max(case when l.l_orderkey is null then cast(0.5 as double) else cast(0.8 as double) end) as confidence
    from {q.t("supplier")} s left join {q.t("lineitem")} l on s.s_suppkey = l.l_suppkey group by s.s_suppkey, case when l.l_orderkey is null then 'inference' else 'document' end"""


def m3_confidence(q: Dialect) -> str:
    """Confidence of an edge from its evidence: 1 - product of the complements, 0.5 if there is none."""
    return f"select l_partkey, l_suppkey, count(*) as evidence_count, round(coalesce(1 - exp(sum(ln(1 - 0.5 * (1 - l_tax)))), 0.5), 3) as confidence from {q.t('lineitem')} group by l_partkey, l_suppkey"


def m5_stats(q: Dialect) -> str:
    return f"with e as ({m1_evidence(q)}) select source_type, cast(sum(n) as bigint) as n, round(avg(confidence), 4) as confidence from e group by source_type"


def n1_pairs(q: Dialect) -> str:
    """Candidate duplicates over all parts, by representatives: a class is one name and brand, named by its least part.

    Every other part of a class is paired with that part (same_label), and the least parts of one name's classes with
    each other (cross_label): two parts have one name if such pairs connect them, and one brand too if same_label pairs
    do. So a class of n parts has n - 1 rows, not n (n - 1) / 2. A part without brand is a class of its own."""
    return f"""with p as (select p_partkey, lower(trim(p_name)) as name, coalesce(p_brand, concat('part:', p_partkey)) as label from {q.t("part")} where p_name is not null),
    c as (select name, label, min(p_partkey) as least_part from p group by name, label)
    select c.least_part as a, p.p_partkey as b, 'same_label' as kind from p join c on p.name = c.name and p.label = c.label and c.least_part < p.p_partkey
    union all select x.least_part, y.least_part, 'cross_label' from c x join c y on x.name = y.name and x.least_part < y.least_part"""


def n2_exact(q: Dialect) -> str:
    return f"with p as ({n1_pairs(q)}) select a, b, 1.0 as score, case when kind = 'same_label' then 'high' else 'low' end as confidence from p"


def n10_descriptions(q: Dialect) -> str:
    return f"select p_partkey, concat(p_brand, ': ', p_name, '. type: ', p_type, '. size: ', cast(p_size as varchar(10))) as description from {q.t('part')}"


DUAL = [l7_degrees, l8_counts, l9_expand, l10_weights, l13_orphans, m1_evidence, m3_confidence, m5_stats, n1_pairs, n2_exact, n10_descriptions]
QUERIES, ORACLES = both({f.__name__: f for f in DUAL})
QUERIES |= {f.__name__: f for f in (k1_knn, k1_filtered, f12_sim_join, k13_edges, k2_mmr, m2_web)}

_D = Dialect()
_NEAR = f"""with {unit(_D, "e")}, s as (select a.vec_id as query_id, b.vec_id, round({cosine(_D)}, 6) as sim from e a join e b on a.vec_id <> b.vec_id where a.vec_id % {QUERIES_OF} = 0 FILTER),
r as (select *, row_number() over (partition by query_id order by sim desc, vec_id) as k from s) select query_id, vec_id, sim, k from r where k <= """
_SIMILAR = f"""with {unit(_D, "e")}, s as (select a.vec_id as src, b.vec_id as dst, round({cosine(_D)}, 4) as weight from e a join e b on a.vec_id % 2 = 0 and b.vec_id % 2 = 1) select * from s where weight >= {LEAST}"""
ORACLES |= {
    "k1_knn": _NEAR.replace("FILTER", "") + "5",
    "k1_filtered": _NEAR.replace("FILTER", "and b.label = 3") + "3",
    "f12_sim_join": _SIMILAR,
    "k13_edges": f"with j as ({_SIMILAR}) select src, count(*) as n, round(avg(weight) + 1e-9, 4) as mean, max(weight) as most from j group by src",
    "m2_web": f"with j as ({_SIMILAR}), t as (select max(vec_id) as top from embeddings), g as (select distinct l_partkey, l_suppkey from lineitem) select l_partkey, l_suppkey, dst as web, round(0.6 * weight, 3) as confidence from g, t, j where j.src = (l_partkey % (top // 2 + 1)) * 2",
}
