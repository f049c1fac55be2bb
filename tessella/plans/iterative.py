"""Queries of the iterative, sequential and streaming operators; their SQL uses recursion or the batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.chunking import batch_sentences, pack_paragraphs, split_documents
from tessella.operators.graph import bfs, components, hops_to, path_precision
from tessella.plans.dialect import Dialect, SparkDialect
from tessella.plans.vectors import n1_pairs, typed
from tessella.session import table
from tessella.streaming import windows

STEP = 20  # every twentieth part and supplier is a start


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"with {typed(SparkDialect(d, spark))} select src, dst from edges")


def _links(spark: SparkSession, d: str) -> DataFrame:
    """The ends of all typed edges as read, repeated ones too: a search needs no exchange that makes them distinct."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    pairs = lambda t, a, a_key, b, b_key: table(spark, d, t).select(key(a, a_key).alias("src"), key(b, b_key).alias("dst"))
    supplied, nations = pairs("lineitem", "part:", "l_partkey", "supplier:", "l_suppkey"), pairs("nation", "nation:", "n_nationkey", "region:", "n_regionkey")
    located = pairs("supplier", "supplier:", "s_suppkey", "nation:", "s_nationkey").unionByName(pairs("customer", "customer:", "c_custkey", "nation:", "c_nationkey"))
    return supplied.unionByName(located).unionByName(nations)


def _starts(spark: SparkSession, d: str) -> DataFrame:
    node = lambda t, k, kind: table(spark, d, t).where(F.col(k) % STEP == 0).select(F.concat(F.lit(kind), F.col(k).cast("string")).alias("node"))
    return node("supplier", "s_suppkey", "supplier:").unionByName(node("part", "p_partkey", "part:"))


def l4_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two hops of each start, over all typed edges."""
    return bfs(_links(spark, d), _starts(spark, d), 2)


def l5_hops(spark: SparkSession, d: str) -> DataFrame:
    """Least hops from each start to any region, however far; one search from the goals serves all starts."""
    goals = table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    return _starts(spark, d).join(hops_to(_edges(spark, d), goals), "node").select(F.col("node").alias("start"), "hops")


def l6_precision(spark: SparkSession, d: str) -> DataFrame:
    """Share of each nation's part-graph edges that are on the path to its region."""
    edges = _edges(spark, d)
    found = edges.where(F.col("dst").startswith("nation:")).select(F.col("dst").alias("question"), "src", "dst")
    gold = found.where(F.col("src").startswith("supplier:"))
    return path_precision(found, gold).withColumn("precision", F.round("precision", 6))


def l7_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the graph of documents and products."""
    e = table(spark, d, "source_documents").where("product_name is not null").select(F.concat(F.lit("doc:"), "doc_id").alias("src"), F.concat(F.lit("prod:"), "product_name").alias("dst"))
    return components(e)


def n6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of duplicate parts of one label, with a flag for more than five."""
    pairs = spark.sql(n1_pairs(SparkDialect(d, spark))).where("kind = 'same_label'").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    own = components(pairs)
    sizes = own.groupBy("component").agg(F.count("*").alias("size"))
    return own.join(sizes, "component").select("node", "component", "size", (F.col("size") > 5).alias("large"))


def n7_merge(spark: SparkSession, d: str) -> DataFrame:
    """Supplier edges of parts after each cluster is merged into its survivor."""
    survivor = n6_clusters(spark, d).select("node", "component")
    edges = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return edges.join(survivor, edges["l_partkey"] == survivor["node"], "left").select(F.coalesce("component", "l_partkey").alias("part"), "l_suppkey").distinct()


def d2_split(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"))


def d6_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_paragraphs(table(spark, d, "documents"))


def d7_batches(spark: SparkSession, d: str) -> DataFrame:
    return batch_sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (l4_bfs, l5_hops, l6_precision, l7_components, n6_clusters, n7_merge, d2_split, d6_packing, d7_batches)}
QUERIES |= {"st1_tumbling": windows.st1_tumbling, "st2_sliding": windows.st2_sliding, "st3_session": windows.st3_session, "st4_dedupe": windows.st4_dedupe, "st5_late": windows.st5_late}

_D = Dialect()
_WALK = f"""with recursive {typed(_D)}, b as (select src, dst from edges union select dst, src from edges),
walk as (select concat('supplier:', s_suppkey) as start, concat('supplier:', s_suppkey) as node, 0 as hops from supplier where s_suppkey % {STEP} = 0
union select concat('part:', p_partkey), concat('part:', p_partkey), 0 from part where p_partkey % {STEP} = 0
union select w.start, b.dst, w.hops + 1 from walk w join b on w.node = b.src where w.hops < 2)"""
_GOALS = f"""with recursive {typed(_D)}, b as (select src, dst from edges union select dst, src from edges),
walk as (select concat('region:', r_regionkey) as node, 0 as hops from region union select b.dst, w.hops + 1 from walk w join b on w.node = b.src where w.hops < 6)"""
_CLUSTERS = f"""with recursive pr as ({n1_pairs(_D)}), l as (select a, b from pr where kind = 'same_label'), b2 as (select a, b from l union select b, a from l),
reach as (select a as node, a as other from b2 union select r.node, b2.b from reach r join b2 on r.other = b2.a), c as (select node, min(other) as component from reach group by node),
z as (select component, count(*) as size from c group by component)"""
ORACLES = {
    "l4_bfs": f"{_WALK} select start, node, min(hops) as hops from walk group by start, node",
    "l5_hops": f"{_GOALS} select node as start, min(hops) as hops from walk where (node like 'supplier:%' or node like 'part:%') and cast(split_part(node, ':', 2) as bigint) % {STEP} = 0 group by node",
    "l6_precision": f"with {typed(_D)} select dst as question, round(cast(count(*) filter (where src like 'supplier:%') as double) / count(*), 6) as precision from edges where dst like 'nation:%' group by dst",
    "l7_components": "with s as (select distinct doc_id, product_name from source_documents where product_name is not null), c as (select product_name, 'doc:' || min(doc_id) as component from s group by product_name) select 'doc:' || s.doc_id as node, component from s join c using (product_name) union all select 'prod:' || product_name, component from c",
    "n6_clusters": f"{_CLUSTERS} select node, c.component, size, size > 5 as large from c join z on c.component = z.component",
    "n7_merge": f"{_CLUSTERS} select distinct coalesce(c.component, l_partkey) as part, l_suppkey from lineitem left join c on l_partkey = c.node",
    "st1_tumbling": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "st2_sliding": "with w as (select unnest([time_bucket(interval '12 hours', ts, timestamp '1970-01-01'), time_bucket(interval '12 hours', ts, timestamp '1970-01-01') - interval '12 hours']) as s from events) select strftime(s, '%Y-%m-%d %H') as start, count(*) as n from w group by 1",
    "st3_session": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval '30 minutes' then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k",
    "st5_late": "with m as (select max(ts) - interval '1 hour' as mark from events) select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as start, count(*) as n from events, m group by date_trunc('hour', ts), mark having date_trunc('hour', ts) + interval '1 hour' <= mark",
    "st4_dedupe": "select distinct event_id, event_type from events",
}
