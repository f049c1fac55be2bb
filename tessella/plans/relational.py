"""Joins, aggregates, windows, top-k and set operations in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.blocks import ordered_pairs
from tessella.operators.ordinal import quantiles, with_group_index, with_position
from tessella.plans.dialect import Dialect, both
from tessella.session import table


def a5_scan_counts(q: Dialect) -> str:
    """Rows of every table."""
    names = "region nation customer supplier part orders lineitem events documents embeddings autoq_questions predictions product_records source_documents products field_catalog mix_targets".split()
    return " union all ".join(f"select '{n}' as table_name, count(*) as n from {q.t(n)}" for n in names)


def a17_cache_missing(q: Dialect) -> str:
    """Keys to compute: documents with no record in the cache, which holds the records loaded up to a day."""
    cache = f"(select doc_id from {q.t('product_records')} where loaded_at < timestamp '2024-03-01 00:00:00')"
    return f"select s.doc_id from {q.t('source_documents')} s {'left anti' if q.spark else 'anti'} join {cache} r on s.doc_id = r.doc_id"


def a19_digest(q: Dialect) -> str:
    """Digest of every question's text."""
    return f"select distinct id, {'sha2(question, 256)' if q.spark else 'sha256(question)'} as digest from {q.t('autoq_questions')} where question is not null"


def b10_metadata_filter(q: Dialect) -> str:
    """Equality on metadata, pushed to the scan."""
    return f"select doc_id, title from {q.t('source_documents')} where doc_type = 'datasheet' and platform = 'fire_alarm'"


def b12_in_list(q: Dialect) -> str:
    """Questions of the hard classes."""
    return f"select distinct id, query_class from {q.t('autoq_questions')} where query_class in ('multi_hop', 'comparison', 'global_thematic', 'relationship_reasoning')"


def b22_coerce(q: Dialect) -> str:
    """Field values that are numbers, others null."""
    return f"select distinct record_id, try_cast({q.sub('field_value', ',', '')} as double) as number from {q.t('product_records')} where {q.like('field_value', '^[0-9.,]+$')}"


def b23_clamp(q: Dialect) -> str:
    """Values kept in a range."""
    return f"select event_id, greatest(1.0, least(5.0, value)) as clamped from {q.t('events')}"


def b26_backfill(q: Dialect) -> str:
    """Missing document types filled from the path, else other."""
    return f"select doc_id, coalesce(doc_type, case when source_path like '%install%' then 'installation' when source_path like '%datasheet%' then 'datasheet' when source_path like '%manual%' then 'manual' else 'other' end) as doc_type from {q.t('source_documents')}"


def f3_inner(q: Dialect) -> str:
    """Inner join of the two systems' predictions with suffixed columns."""
    p = f"(select distinct id, model_name, answer, latency_ms from {q.t('predictions')})"
    return f"select g.id, g.answer as answer_graph, v.answer as answer_vector, g.latency_ms - v.latency_ms as slower from {p} g join {p} v on g.id = v.id where g.model_name = 'graph_walk' and v.model_name = 'dense_small'"


def f4_positional(spark: SparkSession, d: str) -> DataFrame:
    """Rows joined by position in a stated order."""
    n = with_position(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "k", 1)
    s = with_position(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], "k", 1)
    return n.join(s, "k").select("k", "n_name", "s_name")


def f5_multi_key(q: Dialect) -> str:
    """Join on two keys."""
    return f"select d.doc_id, d.product_name, p.product_kind from {q.t('source_documents')} d join {q.t('products')} p on d.product_name = p.product_name and d.platform = p.platform"


def f6_lookup(q: Dialect) -> str:
    """Dictionary lookup in which the last duplicate wins."""
    pick = "max_by(model_name, concat(timestamp_utc, model_name))" if q.spark else "arg_max(model_name, concat(timestamp_utc, model_name))"
    return f"select id, {pick} as last_model from {q.t('predictions')} group by id"


def f7_self_ineq(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parts of one normalised name, each pair once."""
    return ordered_pairs(table(spark, d, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("name")), "name", "p_partkey")


def f8_pairs(q: Dialect) -> str:
    """Unordered pairs of parts within each order, counted over orders."""
    return f"select a.l_partkey as a, b.l_partkey as b, count(distinct a.l_orderkey) as weight from {q.t('lineitem')} a join {q.t('lineitem')} b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by a.l_partkey, b.l_partkey"


def f11_two_hop(q: Dialect) -> str:
    """Customer to nation to region, by left joins."""
    return f"select c.c_custkey, n.n_name, r.r_name from {q.t('customer')} c left join {q.t('nation')} n on c.c_nationkey = n.n_nationkey left join {q.t('region')} r on n.n_regionkey = r.r_regionkey"


def f13_semi(q: Dialect) -> str:
    """Customers with an open order."""
    return f"select c_custkey from {q.t('customer')} {'left semi' if q.spark else 'semi'} join (select o_custkey from {q.t('orders')} where o_orderstatus = 'O') o on c_custkey = o_custkey"


def f13_anti(q: Dialect) -> str:
    """Customers without an urgent order that is open."""
    return f"select c_custkey from {q.t('customer')} {'left anti' if q.spark else 'anti'} join (select o_custkey from {q.t('orders')} where o_orderpriority = '1-URGENT' and o_orderstatus = 'O') o on c_custkey = o_custkey"


def g4_value_counts(q: Dialect) -> str:
    """Frequency table with the null group."""
    return f"select lang, count(*) as n from {q.t('documents')} group by lang"


def g7_count_if(q: Dialect) -> str:
    """Conditional counts by group."""
    return f"select l_returnflag, {q.count_if('l_discount > 0.05')} as discounted, {q.count_if('l_quantity >= 25')} as large from {q.t('lineitem')} group by l_returnflag"


def g8_stats(q: Dialect) -> str:
    """Mean, sample deviation, least and greatest by group."""
    return f"select event_type, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, min(value) as low, max(value) as high from {q.t('events')} group by event_type"


def g9_sums(q: Dialect) -> str:
    """Pricing summary by flag and status."""
    return f"select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from {q.t('lineitem')} where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus"


def g10_median(spark: SparkSession, d: str) -> DataFrame:
    """Exact median by histogram refinement."""
    return quantiles(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", {"mid": 0.5})


def g11_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """2.5 and 97.5 per cent, exact and interpolated, by histogram refinement."""
    return quantiles(table(spark, d, "events"), "event_type", "value", {"low": 0.025, "high": 0.975}).withColumns({c: F.round(c, 6) for c in ("low", "high")})


def g12_noisy_or(q: Dialect) -> str:
    """1 - product of the complements, by the sum of logarithms; a certain item makes the whole certain."""
    return f"select l_orderkey, round(case when max(l_discount * 10) >= 1 then cast(1 as double) else 1 - exp(sum(case when l_discount * 10 < 1 then ln(1 - l_discount * 10) end)) end + cast(0.000000001 as double), 3) as confidence from {q.t('lineitem')} group by l_orderkey"


def g13_distinct(q: Dialect) -> str:
    return f"select l_suppkey, count(distinct l_partkey) as parts, count(distinct l_orderkey) as orders from {q.t('lineitem')} group by l_suppkey"


def g14_collect(q: Dialect) -> str:
    """Sorted distinct values of each group, joined."""
    return f"select platform, {q.join(q.collect('doc_type'), '|')} as doc_types from {q.t('source_documents')} where doc_type is not null group by platform"


def g15_first(q: Dialect) -> str:
    """The first known revision of each product, in order of publication; nulls are passed over."""
    pick = "min_by" if q.spark else "arg_min"
    return f"select product_name, {pick}(revision, concat(coalesce(cast(published_at as {'string' if q.spark else 'varchar'}), ''), '|', doc_id)) filter (where revision is not null) as revision from {q.t('source_documents')} group by product_name"


def g17_normalise(q: Dialect) -> str:
    """Weights scaled by the global maximum with a floor of 0.1; the maximum is one row, not a window over all."""
    return f"with w as (select l_partkey, count(distinct l_orderkey) as shared from {q.t('lineitem')} group by l_partkey) select l_partkey, round(cast(0.1 as double) + cast(0.9 as double) * shared / (select max(shared) from w), 4) as weight from w"


def g18_null_mean(q: Dialect) -> str:
    """Mean that skips nulls and non-numbers."""
    return f"select model_name, round(avg(latency_ms), 6) as latency from (select distinct * from {q.t('predictions')}) p group by model_name"


def g20_buckets(q: Dialect) -> str:
    """Confidence buckets."""
    return f"select {q.count_if('value >= 20')} as high, {q.count_if('value >= 5 and value < 20')} as medium, {q.count_if('value < 5')} as low, {q.count_if('value is null')} as missing from {q.t('events')}"


def g23_labels(q: Dialect) -> str:
    """Label counts after unnesting."""
    return f"with l as (select {q.explode(q.array('product_kind', 'platform'))} as label from {q.t('products')}) select label, count(*) as n from l group by label"


def g24_dups(q: Dialect) -> str:
    """Repeats inside a list: words of a text that occur before."""
    w = q.find("lower(text)", "[a-z]+")
    return f"select doc_id, {q.size(w)} - {q.size(q.distinct(w))} as repeats from {q.t('documents')} where text is not null"


def g25_upsert(q: Dialect) -> str:
    """Edge upsert: count, greatest confidence and first evidence of each edge."""
    first = "min_by(l_orderkey, l_orderkey * 10 + l_linenumber)" if q.spark else "arg_min(l_orderkey, l_orderkey * 10 + l_linenumber)"
    return f"select l_partkey as src, l_suppkey as dst, count(*) as weight, max(l_discount) as confidence, {first} as first_order from {q.t('lineitem')} group by l_partkey, l_suppkey"


def h1_index(spark: SparkSession, d: str) -> DataFrame:
    """Running index in each group, from 0; a hot group is numbered by many tasks."""
    return with_group_index(table(spark, d, "source_documents").select("product_name", "doc_id"), "product_name", ["doc_id"]).select("doc_id", "k")


def h2_first3(q: Dialect) -> str:
    """The first three of each group."""
    return f"select id, query_class from (select id, query_class, row_number() over (partition by query_class order by id) as k from (select distinct id, query_class from {q.t('autoq_questions')}) x) y where k <= 3"


def h3_renumber(spark: SparkSession, d: str) -> DataFrame:
    """Ids continued after another table's greatest."""
    top = table(spark, d, "customer").agg(F.max("c_custkey").alias("top"))
    rows = with_position(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], "k", 1)
    return rows.select("s_name", (F.col("k") + top.scalar()).alias("new_id"))


def h4_running(q: Dialect) -> str:
    """Running count of errors by user: the section a row belongs to."""
    return f"select event_id, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as section from {q.t('events')}"


def h5_keep_first(q: Dialect) -> str:
    """The first row of each key in a stated order."""
    return f"select product_name, doc_id from (select product_name, doc_id, row_number() over (partition by product_name order by published_at, doc_id) as k from {q.t('source_documents')}) x where k = 1"


def h8_neighbours(q: Dialect) -> str:
    """Sum over two rows before and after."""
    return f"select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following), 6) as around from {q.t('events')}"


def h9_lead(q: Dialect) -> str:
    """The next event of the user."""
    return f"select event_id, lead(event_type) over (partition by user_id order by ts, event_id) as following from {q.t('events')}"


def i1_sort(q: Dialect) -> str:
    return f"select o_orderkey, o_totalprice from {q.t('orders')} where o_orderpriority = '1-URGENT' order by o_totalprice desc, o_orderkey"


def i3_topk(q: Dialect) -> str:
    """The three dearest orders of each customer."""
    return f"select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from {q.t('orders')}) x where k <= 3"


def i8_sample(q: Dialect) -> str:
    """Seeded sample: of each platform the five documents with the smallest hashes."""
    return f"select platform, doc_id from (select platform, doc_id, row_number() over (partition by platform order by md5(concat('seed42', doc_id)), doc_id) as k from {q.t('source_documents')}) x where k <= 5"


def j1_union(q: Dialect) -> str:
    """Union of tables with a data set tag."""
    return f"select 'customer' as dataset, c_name as name from {q.t('customer')} union all select 'supplier' as dataset, s_name as name from {q.t('supplier')}"


def j3_setops(q: Dialect) -> str:
    """Product names in documents but not in records, and in both."""
    a, b = f"select product_name from {q.t('products')}", f"select product_name from {q.t('product_records')}"
    return f"select product_name, 'both' as side from ({a} intersect {b}) x union all select product_name, 'only' as side from ({a} except {b}) y"


def j4_multiset(q: Dialect) -> str:
    """Multiset intersection of the words of question and answer: sum of the smaller counts."""
    side = lambda c: f"select id, w, count(*) as n from (select id, {q.explode('ws')} as w from (select distinct id, {q.find(f'lower(coalesce({c}, {chr(39) * 2}))', '[a-z0-9]+')} as ws from {q.t('autoq_questions')}) d) e group by id, w"
    return f"select a.id, cast(sum(least(a.n, b.n)) as bigint) as shared from ({side('question')}) a join ({side('ground_truth')}) b on a.id = b.id and a.w = b.w group by a.id"


def j6_record_dedupe(q: Dialect) -> str:
    """Of each document's field and value (lower case) the first record."""
    return f"select record_id from (select record_id, row_number() over (partition by doc_id, field_name, lower(field_value) order by record_id) as k from (select distinct record_id, doc_id, field_name, field_value from {q.t('product_records')}) r) x where k = 1"


ORDINAL = [f4_positional, h3_renumber, h1_index, g10_median, g11_quantiles]
BLOCKS = [f7_self_ineq]
DUAL = [f for n, f in dict(globals()).items() if n[:1] in "abfghij" and n[1:2].isdigit() and f not in ORDINAL + BLOCKS]
QUERIES, ORACLES = both({f.__name__: f for f in DUAL})
QUERIES |= {f.__name__: f for f in ORDINAL + BLOCKS}
ORACLES |= {
    "f4_positional": "select n.k, n.n_name, s.s_name from (select n_name, row_number() over (order by n_nationkey) as k from nation) n join (select s_name, row_number() over (order by s_suppkey) as k from supplier) s on n.k = s.k",
    "f7_self_ineq": "select a.p_partkey as a, b.p_partkey as b from part a join part b on lower(trim(a.p_name)) = lower(trim(b.p_name)) and a.p_partkey < b.p_partkey",
    "h3_renumber": "select s_name, row_number() over (order by s_suppkey) + (select max(c_custkey) from customer) as new_id from supplier",
    "h1_index": "select doc_id, row_number() over (partition by product_name order by doc_id) - 1 as k from source_documents",
    "g10_median": "select l_returnflag, median(l_quantity) as mid from lineitem group by l_returnflag",
    "g11_quantiles": "select event_type, round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.975), 6) as high from events group by event_type",
}
