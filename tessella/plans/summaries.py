"""Evaluation summaries, audits over several data sets, graph audits, entity resolution and evidence, in both dialects.

Judges and model metrics are providers; their stated defaults are used here: the metrics of containment and overlap, and
the better system by the composite score as the judge, with a confidence that grows with the difference.
"""

from __future__ import annotations

from tessella.plans.dialect import Dialect, both, quote
from tessella.plans.evaluate import contexts, mean4, o9_rows, o10_hits, q1_audit, rate4, strip, tokens
from tessella.plans.vectors import n1_pairs, typed

TIE, SURE = 500, 7000  # ten-thousandths
FOUR = ["faithfulness", "answer_relevancy", "context_precision", "entity_recall"]
REFUSALS = ["cannot provide", "unable to", "does not contain"]


def results(q: Dialect) -> str:
    """CTE r: the row results of both systems in ten-thousandths, with the judge's choice and confidence."""
    whole = ", ".join(f"cast(round({s}_{m} * 10000) as bigint) as {s}_{m}" for s in ("graph", "vector") for m in [*FOUR, "answer_correctness", "score"])
    return q.once("r", f"""o as ({o9_rows(q)}), w as (select id, query_class, winner, failure_mode, {whole} from o),
    j as (select *, graph_answer_correctness - vector_answer_correctness as delta from w),
    r as (select *, case when abs(delta) <= {TIE} then 'tie' when delta > 0 then 'graph' else 'vector' end as judge, least(10000, 5000 + abs(delta)) as confidence from j)""")


def vote(q: Dialect) -> str:
    won = lambda s, o: " + ".join(f"case when {s}_{m} - {o}_{m} > {TIE} then 1 else 0 end" for m in FOUR)
    return f"(case when {won('graph', 'vector')} > {won('vector', 'graph')} then 'graph' when {won('vector', 'graph')} > {won('graph', 'vector')} then 'vector' else 'tie' end)"


def o14_vote(q: Dialect) -> str:
    """Both systems by votes of the four model metrics: each metric goes to the system ahead by more than 0.05."""
    one = ", ".join(f"case when abs(graph_{m} - vector_{m}) <= {TIE} then 'tie' when graph_{m} > vector_{m} then 'graph' else 'vector' end as {m}_winner" for m in FOUR)
    return f"with {results(q)} select id, query_class, {one}, {vote(q)} as metrics_winner from r"


def o14_summary(q: Dialect) -> str:
    """How often each system wins the vote."""
    return f"with {results(q)}, v as (select {vote(q)} as metrics_winner from r) select metrics_winner, count(*) as n from v group by metrics_winner"


def o15_stage(q: Dialect) -> str:
    """The stage at which the graph system's answer failed: retrieval, weak context, support, correctness; and how it is reached."""
    return f"""with {results(q)}, h as (select id, graph_hit from ({o10_hits(q)}) x) select r.id, r.query_class, case when h.graph_hit = 'miss' then 'retrieval_miss' when h.graph_hit = 'uncertain' then 'weak_context' when r.graph_faithfulness < 5000 then 'unsupported_answer' when r.graph_answer_correctness < 5000 then 'incorrect_answer' else 'correct' end as stage from r join h on r.id = h.id"""


def o15_counts(q: Dialect) -> str:
    """Stages by class, with the share in the class."""
    return f"with s as ({o15_stage(q)}), n as (select query_class, stage, count(*) as n from s group by query_class, stage), t as (select query_class, sum(n) as total from n group by query_class) select n.query_class, n.stage, n.n, cast({q.ratio4('n.n', 't.total')} as double) / 10000 as share from n join t on n.query_class is not distinct from t.query_class"


def answers(q: Dialect) -> str:
    """CTE a: every answer with the truth, containment both ways and refusal."""
    norm = lambda x: "trim(" + q.sub(f"lower({x})", "[^a-z0-9]+", " ") + ")"
    refusal = " or ".join(f"contains(lower(answer), {quote(t)})" for t in REFUSALS)
    return f"""qa as (select id, min(ground_truth) as truth from {q.t("autoq_questions")} where id is not null group by id), pa as (select distinct id, model_name, coalesce(answer, '') as answer, latency_ms, {q.size(contexts(q, "retrieved_contexts"))} as n_ctx from {q.t("predictions")}),
    pn as (select pa.*, {norm("answer")} as x, {norm("coalesce(truth, '')")} as y, {tokens(q, "answer")} as xt, {tokens(q, "coalesce(truth, '')")} as yt from pa join qa on pa.id = qa.id),
    a as (select *, x <> '' and y <> '' and (contains(x, y) or contains(y, x)) as correct, {refusal} as refusal, case when {q.size("yt")} = 0 then 0 else {q.ratio4(q.size(q.common("xt", "yt")), "greatest(1, " + q.size("yt") + ")")} end as score from pn)"""


def o16_semantic(q: Dialect) -> str:
    """Semantic accuracy of each model: answers of a score of at least 0.75, mean score, answers given, refusals and containment."""
    produced = f"{strip(q, 'answer')} <> '' and not refusal"
    return f"""with {answers(q)} select model_name, count(*) as questions, {rate4(q, "score >= 7500")} as semantic_accuracy, {mean4(q, "score")} as avg_semantic_score, {rate4(q, produced)} as answer_rate, {rate4(q, "refusal")} as refusal_rate, {rate4(q, "correct")} as exact_match_accuracy from a group by model_name"""


def o17_graph(q: Dialect) -> str:
    """Comparison of the models: share reached (an answer within three contexts), mean place, accuracy and latency; blanks are skipped."""
    return f"""with {answers(q)} select model_name, {rate4(q, "n_ctx between 1 and 3")} as reachability_at_3, round(avg(case when n_ctx > 0 then cast(n_ctx as double) end), 4) as avg_hops, {rate4(q, "correct")} as qa_accuracy, round(avg(latency_ms), 4) as avg_latency from a group by model_name"""


def o18_fallback(q: Dialect) -> str:
    """A metric by its chain of names: the system's own column, the one with the name behind, the plain one, else 0."""
    return f"select distinct id, model_name, coalesce(try_cast(run_id as double), cast(latency_ms as double), try_cast(answer as double), cast(0 as double)) as value from {q.t('predictions')}"


def g19_agreement(q: Dialect) -> str:
    """Agreement of the deterministic winner and the judge: both alike, and alike among those decided."""
    return f"with {results(q)} select count(*) as n, {rate4(q, 'winner = judge')} as agreement, cast({q.ratio4(q.count_if('winner = judge and winner in (' + chr(39) + 'graph' + chr(39) + ', ' + chr(39) + 'vector' + chr(39) + ')'), 'greatest(1, ' + q.count_if('winner in (' + chr(39) + 'graph' + chr(39) + ', ' + chr(39) + 'vector' + chr(39) + ') and judge <> ' + chr(39) + 'tie' + chr(39)) + ')')} as double) / 10000 as decided_agreement from r"


def stat4_judge(q: Dialect) -> str:
    """Judge and metric within 0.1 of one another, by class: the judge's score in steps of a quarter against the composite."""
    step = "cast(floor((graph_answer_correctness + 1250) / 2500.0) * 2500 as bigint)"
    return f"with {results(q)}, d as (select query_class, abs({step} - graph_score) as delta from r) select query_class, count(*) as n, {rate4(q, 'delta <= 1000')} as agreement from d group by query_class"


def stat5_variance(q: Dialect) -> str:
    """Sample variance of the metrics over each class; one row has none."""
    cols = ", ".join(f"round(var_samp(cast(graph_{m} as double) / 10000), 6) as {m}" for m in FOUR)
    return f"with {results(q)} select query_class, count(*) as n, {cols} from r group by query_class"


def flags(q: Dialect) -> str:
    """CTE f: flags of the three verdicts of each question."""
    flag = lambda c, n: f"case when {c} then '{n}' end"
    v = vote(q)
    return f"""{results(q)}, f as (select id, query_class, winner, {v} as metrics_winner, judge, confidence, concat_ws(';', {flag("winner <> judge", "deterministic_vs_judge")}, {flag(v + " <> judge", "metrics_vs_judge")}, {flag("winner <> " + v, "deterministic_vs_metrics")},
    {flag("winner = 'tie' and judge <> 'tie' and confidence >= 8000", "metric_tie_judge_prefers_system")}, {flag(f"confidence < {SURE}", "low_judge_confidence")}) as flags from r)"""


def q5_rows(q: Dialect) -> str:
    """Disagreements between the deterministic winner, the metrics' vote and the judge, as flags."""
    return f"with {flags(q)} select id, query_class, winner, metrics_winner, judge, cast(confidence as double) / 10000 as confidence, flags, flags <> '' as has_disagreement from f"


def q5_summary(q: Dialect) -> str:
    """How often each flag stands, and confidence bands."""
    return f"""with {flags(q)}, x as (select {q.explode(q.split("flags", ";"))} as flag from f where flags <> '') select flag, count(*) as n from x group by flag
    union all select 'confidence_high', {q.count_if("confidence >= 8000")} from f union all select 'confidence_medium', {q.count_if("confidence >= 6000 and confidence < 8000")} from f union all select 'confidence_low', {q.count_if("confidence < 6000")} from f"""


def q7_combined(q: Dialect) -> str:
    """Rows of several data sets in one table with the data set's name, and their aggregates over the union."""
    part = lambda name, where: f"select '{name}' as dataset_name, id, query_class, winner, graph_score, vector_score from r where {where}"
    return f"""with {results(q)}, u as ({part("hard", "query_class in ('multi_hop', 'comparison', 'global_thematic', 'relationship_reasoning')")} union all {part("easy", "query_class not in ('multi_hop', 'comparison', 'global_thematic', 'relationship_reasoning')")} union all {part("unclassified", "query_class is null")})
    select dataset_name, query_class, count(*) as n, {q.count_if("winner = 'graph'")} as graph_wins, {mean4(q, "graph_score")} as graph_score, {mean4(q, "vector_score")} as vector_score, grouping(query_class) as over_all from u group by grouping sets ((dataset_name, query_class), (dataset_name))"""


def q8_snapshot(q: Dialect) -> str:
    """One row that keeps an experiment: counts and means of all stages (q12 its parts: results, retrieval, answers, audit)."""
    return f"""with {results(q)}, h as ({o10_hits(q)}), au as ({q1_audit(q)}), {answers(q)}
    select (select count(*) from r) as n_rows, (select {mean4(q, "graph_score")} from r) as graph_score, (select {rate4(q, "graph_hit = 'hit'")} from h) as retrieval_hit_rate, (select {rate4(q, "correct")} from a) as answer_accuracy, (select {rate4(q, "quality_flags = ''")} from au) as clean_rate, cast(null as double) as missing_part"""


def q9_manifest(q: Dialect) -> str:
    """A manifest: rows and columns of every input, and a digest of its keys that does not depend on order."""
    keys = {"autoq_questions": "id", "predictions": "id", "product_records": "record_id", "source_documents": "doc_id", "products": "product_name"}
    return " union all ".join(f"select '{t}' as table_name, count(*) as n_rows, count(distinct {k}) as n_keys, cast(sum({q.hash_int(k)}) as decimal(38,0)) as digest from {q.t(t)}" for t, k in keys.items())


def q10_flags(q: Dialect) -> str:
    """The audit flags of both systems beside each question; null and empty flags are no flags."""
    return f"""with au as ({q1_audit(q)}) select id, max(case when system = 'graph' then quality_flags end) as graph_flags, max(case when system = 'vector' then quality_flags end) as vector_flags from au group by id"""


def q6_audit(q: Dialect) -> str:
    """Cost and latency of each model: prompts of the contexts and answers as estimated tokens, with rates for input and output; missing latencies are counted."""
    est = lambda x: f"greatest(1, cast(floor(length({x}) / 4.0) as bigint))"
    return f"""with p as (select distinct id, model_name, coalesce(answer, '') as answer, coalesce(retrieved_contexts, '') as ctx, latency_ms from {q.t("predictions")}), t as (select model_name, latency_ms, {est("ctx")} as tok_in, {est("answer")} as tok_out from p)
    select model_name, count(*) as n_rows, {q.count_if("latency_ms is null")} as latency_not_supplied, cast(sum(coalesce(latency_ms, 0)) as bigint) as latency_ms, cast(sum(tok_in) as bigint) as input_tokens, cast(sum(tok_out) as bigint) as output_tokens, round(cast(sum(tok_in) as double) / 1000000 * 1.0 + cast(sum(tok_out) as double) / 1000000 * 2.0, 8) as est_cost from t group by model_name"""


def l11_export(q: Dialect) -> str:
    """The typed graph for export: names in lower case, empty ones dropped, of repeated edges the one loaded last."""
    pick = "max_by" if q.spark else "arg_max"
    name = lambda c: f"trim(lower({c}))"
    return f"select {name('product_name')} as src, {name('field_name')} as relation, {pick}({name('field_value')}, concat(cast(loaded_at as varchar(40)), record_id)) as dst from {q.t('product_records')} where trim(coalesce(product_name, '')) <> '' and trim(coalesce(field_name, '')) <> '' and trim(coalesce(field_value, '')) <> '' group by {name('product_name')}, {name('field_name')}" if not q.spark else f"select src, relation, max_by(dst, at) as dst from (select {name('product_name')} as src, {name('field_name')} as relation, {name('field_value')} as dst, concat(cast(loaded_at as string), record_id) as at from {q.t('product_records')} where trim(coalesce(product_name, '')) <> '' and trim(coalesce(field_name, '')) <> '' and trim(coalesce(field_value, '')) <> '') x group by src, relation"


def l12_audit(q: Dialect) -> str:
    """Audit of the typed graph: nodes by kind, relations by name, and triples by pattern of kinds."""
    kind = lambda c: f"{q.group(c, '^([a-z]+):')}"
    return f"""with {typed(q)}, n as (select src as node from edges union select dst from edges)
    select 'node' as what, {kind("node")} as name, count(*) as n from n group by {kind("node")} union all select 'relation', rel, count(*) from edges group by rel
    union all select 'pattern', concat({kind("src")}, '-', rel, '-', {kind("dst")}), count(*) from edges group by concat({kind("src")}, '-', rel, '-', {kind("dst")})"""


def l12_sample(q: Dialect) -> str:
    """Twenty sample triples, in order (the sample is the feature)."""
    return f"with {typed(q)} select src, rel, dst from edges order by src, rel, dst limit 20"


def l14_merge(q: Dialect) -> str:
    """Idempotent upsert of relations: of the known ones and of new ones that fit an allowed pattern, each once."""
    kind = lambda c: f"{q.group(c, '^([a-z]+):')}"
    fresh = f"select concat('part:', p_partkey) as src, case when p_partkey % 3 = 0 then concat('region:', p_partkey % 5) else concat('supplier:', p_partkey % 50 + 1) end as dst, 'supplied_by' as rel from {q.t('part')}"
    return f"""with {typed(q)}, allowed as (select distinct {kind("src")} as a, rel as allowed_rel, {kind("dst")} as b from edges), fresh as ({fresh}), good as (select f.src, f.dst, f.rel from fresh f join allowed on {kind("f.src")} = a and f.rel = allowed_rel and {kind("f.dst")} = b)
    select src, dst, rel from edges union select src, dst, rel from good"""


def l15_delete(q: Dialect) -> str:
    """Edges left after all nodes of one label are deleted."""
    return f"with {typed(q)} select rel, count(*) as n from edges where src not like 'customer:%' and dst not like 'customer:%' group by rel"


def l16_sources(q: Dialect) -> str:
    """Statistics of the sources of documents: chunks, documents and products they name."""
    return f"select source_type, count(*) as chunks, count(distinct doc_id) as documents, count(distinct product_name) as linked from {q.t('source_documents')} group by source_type"


def f10_shared(q: Dialect) -> str:
    """Edges of a supplier and a part with the orders both stand in by other rows: the optional path over a shared chunk."""
    m = f"(select distinct l_orderkey, l_suppkey from {q.t('lineitem')})"
    return f"""with e as (select distinct l_partkey, l_suppkey from {q.t("lineitem")} where l_partkey % 20 = 0), p as (select distinct l_orderkey, l_partkey from {q.t("lineitem")} where l_partkey % 20 = 0)
    select e.l_partkey, e.l_suppkey, count(distinct m.l_orderkey) as shared from e left join p on e.l_partkey = p.l_partkey left join {m} m on p.l_orderkey = m.l_orderkey and m.l_suppkey = e.l_suppkey group by e.l_partkey, e.l_suppkey"""


def f15_exists(q: Dialect) -> str:
    """Parts for which some order line of another flag exists."""
    return f"select distinct p_partkey from {q.t('part')} p where exists (select 1 from {q.t('lineitem')} l where l.l_partkey = p.p_partkey and l.l_returnflag = 'R' and l.l_quantity > 45)"


def f2_chain(q: Dialect) -> str:
    """Optional left joins one after the other, ids as text; a missing side leaves nulls."""
    side = lambda m: f"(select cast(id as varchar(40)) as id, max(answer) as answer from {q.t('predictions')} where model_name = '{m}' group by id)"
    return f"select a.id, g.answer as graph_answer, v.answer as vector_answer, n.answer as other_answer from (select distinct cast(id as varchar(40)) as id from {q.t('autoq_questions')} where id is not null) a left join {side('graph_walk')} g on a.id = g.id left join {side('dense_small')} v on a.id = v.id left join {side('no_such_model')} n on a.id = n.id"


def words_of(q: Dialect, x: str) -> str:
    return q.find(f"lower({x})", "[a-z0-9]+")


def n3_embed(q: Dialect) -> str:
    """Embedding score of candidate pairs of parts: cosine of the word counts of their descriptions, with bands of confidence one level lower across labels."""
    at = lambda a, b: q.map(a, "z", q.size(q.filter(b, "y", "y = z")))
    total = lambda a: f"cast(aggregate({a}, cast(0 as bigint), (s, v) -> s + v) as double)" if q.spark else f"coalesce(cast(list_sum({a}) as double), 0)"
    text = "concat(coalesce(p_brand, ''), ': ', coalesce(p_name, ''), '. type: ', coalesce(p_type, ''), '. size: ', coalesce(cast(p_size as varchar(10)), ''))"
    return f"""with pr as ({n1_pairs(q)}), d as (select p_partkey, {words_of(q, text)} as w from {q.t("part")}), s as (select a, b, kind, x.w as wa, y.w as wb from pr join d x on pr.a = x.p_partkey join d y on pr.b = y.p_partkey),
    c as (select a, b, kind, round({total(at("wa", "wb"))} / sqrt({total(at("wa", "wa"))} * {total(at("wb", "wb"))}) + cast(0.000000001 as double), 4) as score from s)
    select a, b, kind, score, case when score >= 0.92 then case when kind = 'same_label' then 'high' else 'medium' end when score >= 0.85 and kind = 'same_label' then 'medium' else 'low' end as confidence from c"""


def n5_escalate(q: Dialect) -> str:
    """Pairs of medium or low confidence get the model's verdict (its default: alike descriptions merge), the others keep theirs."""
    return f"""with e as ({n3_embed(q)}) select a, b, score, confidence, case when confidence = 'high' then 'MERGE' when score >= 0.9 then 'MERGE' when score >= 0.8 then 'REVIEW' else 'KEEP' end as verdict, case when confidence = 'high' then score when score >= 0.9 then 1.0 when score >= 0.8 then 0.5 else 0.0 end as final_score from e"""


def n9_report(q: Dialect) -> str:
    """Duplicates by kind and name: pairs of representatives and parts concerned."""
    return f"with pr as ({n1_pairs(q)}), p as (select p_partkey, lower(trim(p_name)) as name from {q.t('part')}) select p.name, pr.kind, count(*) as pairs, count(distinct pr.b) as parts from pr join p on pr.b = p.p_partkey group by p.name, pr.kind"


def n11_snapshot(q: Dialect) -> str:
    """Every tenth node before a merge: its properties, and its relations out and in as lists."""
    return f"""with {typed(q)}, n as (select concat('supplier:', s_suppkey) as node, s_name as name from {q.t("supplier")} where s_suppkey % 10 = 0), o as (select src, {q.join(q.collect("concat(rel, '>', dst)"), "|")} as outs from edges where src like 'supplier:%' group by src), i as (select dst, count(*) as n_in from edges where dst like 'supplier:%' group by dst)
    select n.node, n.name, o.outs, coalesce(i.n_in, 0) as n_in from n left join o on n.node = o.src left join i on n.node = i.dst"""


def n8_undo(q: Dialect) -> str:
    """Edges after a merge and its undo: the kept version of the table gives every edge back; reported as counts before, merged and restored."""
    e = f"select distinct l_partkey, l_suppkey from {q.t('lineitem')}"
    return f"""with e as ({e}), pr as ({n1_pairs(q)}), s as (select b, min(a) as a from pr where kind = 'same_label' group by b), m as (select distinct coalesce(s.a, e.l_partkey) as part, e.l_suppkey from e left join s on e.l_partkey = s.b)
    select (select count(*) from e) as before_merge, (select count(*) from m) as merged, (select count(*) from (select e.l_partkey, e.l_suppkey from e join (select coalesce(s.a, e.l_partkey) as part, e.l_partkey as own, e.l_suppkey as sup from e left join s on e.l_partkey = s.b) k on e.l_partkey = k.own and e.l_suppkey = k.sup) x) as restored"""


def m4_temporal(q: Dialect) -> str:
    """Evidence with its time of validity where it is no inference: first and last order of each part and supplier, in batches of 15 by the key."""
    return f"""with e as (select l_partkey, l_suppkey, min(l_shipdate) as valid_from, max(l_shipdate) as valid_to, count(*) as n from {q.t("lineitem")} group by l_partkey, l_suppkey)
    select l_partkey, l_suppkey, {q.day("valid_from")} as valid_from, case when n > 1 then {q.day("valid_to")} end as valid_to, l_partkey % 15 as batch from e"""


def b24_patterns(q: Dialect) -> str:
    """Patterns of a schema: for each property the product of its domains and ranges, from the catalogue's types."""
    return f"""with pr as (select quantity as property, field_name as dom from {q.t("field_catalog")} where quantity is not null), ra as (select quantity as property, common_unit as rng from {q.t("field_catalog")} where quantity is not null)
    select distinct dom, pr.property, rng from pr join ra on pr.property = ra.property"""


def b25_registry(q: Dialect) -> str:
    """Statistics of a schema: entries by type, and their names."""
    return f"select value_type, count(*) as n, {q.join(q.collect('field_name'), '|')} as names from {q.t('field_catalog')} group by value_type"


def r2_merged(q: Dialect) -> str:
    """Manual and generated questions in one table: ids of the generated ones continue after the greatest, missing columns are inferred from the class."""
    return f"""with u as (select id, min(question) as question, min(query_class) as query_class, min(source_split) as source_split, min(generation_method) as method from {q.t("autoq_questions")} where try_cast(id as bigint) is not null group by id)
    select id, question, coalesce(query_class, 'local_specific') as query_class, case when query_class in ('multi_hop', 'relationship_reasoning') then 'multi' when query_class is null then 'unknown' else 'single' end as reasoning, coalesce(source_split, 'manual') as source_split, coalesce(method, 'curated') as method from u"""


def packets(q: Dialect) -> str:
    """CTE packets: evidence of every product: its fields and values, the first three of each field by record id."""
    return f"""pk as (select product_name, field_name, record_id, field_value, row_number() over (partition by product_name, field_name order by record_id) as k from (select distinct product_name, field_name, record_id, field_value from {q.t("product_records")}) x where product_name in (select product_name from {q.t("products")}) and field_name in (select field_name from {q.t("field_catalog")}) and field_value is not null),
    packets as (select product_name, count(distinct field_name) as n_fields, count(*) as n_records, {q.join(q.collect("field_name"), "|")} as fields, min(field_value) as sample from pk where k <= 3 group by product_name)"""


def r4_packets(q: Dialect) -> str:
    """Planning of evidence packets: products with records of several fields, by class of question they can carry."""
    return f"with {packets(q)} select product_name, n_fields, n_records, case when n_fields >= 8 then 'multi_hop' when n_fields >= 4 then 'local_global' else 'local_specific' end as query_class from packets"


def r10_properties(q: Dialect) -> str:
    """Properties of a packet: its fields in order, each once, and how many records it has."""
    return f"with {packets(q)} select product_name, fields, n_records from packets"


def r6_fallback(q: Dialect) -> str:
    """Questions of packets: what fails validation is replaced by the template, with the reason kept."""
    return f"""with {packets(q)}, c as (select product_name, sample, concat('What does the ', product_name, ' offer?') as asked from packets), v as (select *, case when length(asked) < 24 then 'question too short' when length(sample) < 1 then 'ground truth too short' end as reason from c)
    select product_name, case when reason is null then asked else concat('What is known of the product named ', product_name, ' in the records?') end as question, coalesce(reason, 'ok') as reason from v"""


def r7_audit(q: Dialect) -> str:
    """Audit of a generation: rows, rejected rows and reasons."""
    return f"with f as ({r6_fallback(q)}) select reason, count(*) as n from f group by reason"


def r8_samples(q: Dialect) -> str:
    """Samples for model metrics: question, answer, contexts and reference of every prediction, those without answer left out."""
    return f"""with qa as (select id, min(question) as question, min(ground_truth) as truth from {q.t("autoq_questions")} where id is not null group by id), p as (select distinct id, model_name, answer, {q.join(contexts(q, "retrieved_contexts"), " | ")} as contexts from {q.t("predictions")} where {strip(q, "coalesce(answer, '')")} <> '')
    select p.id, p.model_name, qa.question as user_input, p.answer as response, p.contexts as retrieved_contexts, qa.truth as reference from p join qa on p.id = qa.id"""


def s9_judge(q: Dialect) -> str:
    """Pairwise judge by its default, the composite score: winner, confidence and reason."""
    return f"with {results(q)} select id, judge as winner, cast(confidence as double) / 10000 as confidence, case when judge = 'tie' then 'scores within tolerance' else concat(judge, ' answers more of the reference') end as rationale from r"


def s10_scores(q: Dialect) -> str:
    """Five-metric judge from 1 to 5 by its default: the metrics of overlap, scaled."""
    cols = ", ".join(f"cast(1 + floor((4 * graph_{m} + 5000) / 10000.0) as bigint) as {m}" for m in [*FOUR, "answer_correctness"])
    return f"with {results(q)} select id, {cols} from r"


def s11_semantic(q: Dialect) -> str:
    """Semantic judge by its default: 1 if one contains the other, a half from half of the words on, else 0."""
    return f"with {answers(q)} select id, model_name, max(case when correct then 1.0 when score >= 5000 then 0.5 else 0.0 end) as semantic_score from a group by id, model_name"


def s19_prompt(q: Dialect) -> str:
    """Contexts as numbered lines of a prompt."""
    number = f"transform(ctx, (c, i) -> concat('[', i + 1, '] ', c))" if q.spark else "list_transform(ctx, lambda c, i: concat('[', i, '] ', c))"  # noqa: F541
    return f"select distinct id, model_name, {q.join(number, chr(10)) if not q.spark else 'array_join(' + number + ', ' + chr(39) + chr(92) + 'n' + chr(39) + ')'} as prompt from (select id, model_name, {contexts(q, 'retrieved_contexts')} as ctx from {q.t('predictions')}) x"


def s20_normalise(q: Dialect) -> str:
    """Judge results in one form: missing scores are 1, all clamped to 1 to 5, reasons cut to 400 characters (the cut is the feature)."""
    return f"select distinct id, greatest(1, least(5, coalesce(cast(latency_ms % 9 as bigint), 1))) as score, substr(coalesce(answer, ''), 1, 400) as rationale from {q.t('predictions')} where id is not null"


DUAL = [f for n, f in dict(globals()).items() if n[:1] in "bfglmnoqrs" and n[1:2].isdigit() and f.__module__ == __name__] + [stat4_judge, stat5_variance]
QUERIES, ORACLES = both({f.__name__: f for f in DUAL})
