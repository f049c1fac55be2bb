"""Evaluation of two answering systems: row metrics, summaries, audits, agreement and resampling.

Scores are kept as whole ten-thousandths until the last step, so that both dialects round alike.
The graph system is the model `graph_walk`, the vector system `dense_small`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.bootstrap import bootstrap
from tessella.plans.dialect import Dialect, both, quote, spark_query

# Stop words of the token sets, query classes that count as hard, class points, error phrases.
STOPWORDS = "a an and are as be by can does for from how in is it of on or that the this to what when where which with".split()
HARD = ["multi_hop", "comparison", "global_thematic", "relationship_reasoning"]
POINTS = {"single_hop_fact": 0, "local_specific": 0, "manual_curated": 1, "comparison": 2, "multi_hop": 2, "relationship_reasoning": 2, "theme_summary": 2, "global_specific": 2, "global_thematic": 3}
ERRORS = ["error code", "rate limit", "rate_limit", "authenticationerror", "apierror", "badrequesterror", "timeout", "exception", "traceback"]
NOT_FOUND = "not found in provided context"
METRICS = ["answer_correctness", "faithfulness", "answer_relevancy", "entity_recall", "context_precision"]
WEIGHTS = [35, 20, 15, 15, 15]  # hundredths, in the order of METRICS


def tokens(q: Dialect, text: str) -> str:
    return q.distinct(q.words(text, STOPWORDS, 2))


def contexts(q: Dialect, cell: str) -> str:
    """The texts of a contexts cell: strings, or objects' text; empty ones dropped."""
    item = f"trim(case when e like '{{%' then coalesce({q.field('e', 'text')}, '') else e end)"
    return q.filter(q.map(q.strings(cell), "e", item), "x", "x <> ''")


def strip(q: Dialect, text: str) -> str:
    return q.sub(text, "^[ \\t\\r\\n\u00a0]+|[ \\t\\r\\n\u00a0]+$", "")


def plain(q: Dialect, text: str) -> str:
    """Lower case, runs of white space one blank, hyphens blanks."""
    return "replace(trim(" + q.sub(f"lower({text})", r"\s+", " ") + "), '-', ' ')"


def signals(q: Dialect, product: str, fields: str) -> str:
    """The expected signals of a question: its products and fields, each once."""
    names = q.split(f"coalesce({product}, '')", "[|,;/]+")
    spoken = q.map(q.strings(f"coalesce({fields}, '')"), "f", "replace(f, '_', ' ')")
    return q.distinct(q.filter(q.map(q.cat(names, spoken), "s", plain(q, "s")), "s", "s <> ''"))


def found(q: Dialect, part: str, text: str, words: str) -> str:
    """Whether a signal (its plain text p and words w) is part of a plain text, or at least 0.8 of its words are among the text's."""
    return f"(contains({text}, {part}.p) or ({q.size(part + '.w')} > 0 and 10 * {q.size(q.common(part + '.w', words))} >= 8 * {q.size(part + '.w')}))"


def parts(q: Dialect, texts: str) -> str:
    """Each text of a list with its plain form p and its words w, computed once."""
    return q.map(texts, "x", q.struct(p=plain(q, "x"), w=tokens(q, "x")))


def cells(q: Dialect) -> str:
    """CTEs up to one row per question with both systems' parsed cells."""
    side = lambda p, m: f"{p} as (select distinct id, coalesce(answer, '') as answer, {contexts(q, 'retrieved_contexts')} as ctx, latency_ms from {q.t('predictions')} where model_name = '{m}')"
    return f"""
    qa as (select distinct id, query_class, coalesce(question, '') as question, coalesce(ground_truth, '') as truth, source_product, source_fields,
           {contexts(q, "contexts")} as gold from {q.t("autoq_questions")}),
    {side("g", "graph_walk")}, {side("v", "dense_small")},
    joined as (select qa.*, coalesce(g.answer, '') as g_answer, coalesce(v.answer, '') as v_answer, coalesce(g.ctx, {q.empty}) as g_ctx, coalesce(v.ctx, {q.empty}) as v_ctx, g.latency_ms as g_latency, v.latency_ms as v_latency
           from qa left join g on qa.id = g.id left join v on qa.id = v.id),
    named as (select joined.*, {signals(q, "source_product", "source_fields")} as expected from joined),
    both_sides as (select named.*, {parts(q, "expected")} as expected_parts, {parts(q, "g_ctx")} as g_parts, {parts(q, "v_ctx")} as v_parts, {tokens(q, "question")} as q_tok, {tokens(q, "truth")} as t_tok,
           {tokens(q, "concat(" + q.join("gold", " ") + ", ' ', truth)")} as gold_tok, {q.join("g_ctx", " ")} as g_text, {q.join("v_ctx", " ")} as v_text from named)"""


def scores(q: Dialect) -> str:
    """CTEs up to one row per question with all metrics of both systems, in ten-thousandths."""

    def side(p: str) -> str:
        words, text = f"{p}_words", f"{p}_plain"
        ans, size = f"{p}_tok", q.size
        useful = q.filter(f"{p}_parts", "c", f"100 * {size(q.common('c.w', 'gold_tok'))} >= 12 * greatest(1, {size('gold_tok')}) or {size(q.filter('expected_parts', 's', found(q, 's', 'c.p', 'c.w')))} > 0")
        mute = f"trim({p}_answer) = '' or lower({p}_answer) like '%{NOT_FOUND}%'"
        intent = q.distinct(q.cat("q_tok", "t_tok"))
        return f"""
        case when {size("expected")} = 0 then 10000 else {q.ratio4(size(q.filter("expected_parts", "s", found(q, "s", text, words))), "greatest(1, " + size("expected") + ")")} end as {p}_entity_recall,
        case when {size(f"{p}_ctx")} = 0 then 0 else {q.ratio4(size(useful), "greatest(1, " + size(f"{p}_ctx") + ")")} end as {p}_context_precision,
        case when {mute} or {size(ans)} = 0 then 0 else {q.ratio4(size(q.common(ans, words)), "greatest(1, " + size(ans) + ")")} end as {p}_faithfulness,
        case when {mute} or {size(intent)} = 0 then 0 else least(10000, {q.ratio4("3 * " + size(q.common(ans, intent)), "greatest(1, 2 * " + size(intent) + ")")}) end as {p}_answer_relevancy,
        case when {mute} or {size("t_tok")} = 0 then 0 else {q.ratio4(size(q.common(ans, "t_tok")), "greatest(1, " + size("t_tok") + ")")} end as {p}_answer_correctness"""

    total = lambda p: "cast(floor((" + " + ".join(f"{w} * {p}_{m}" for m, w in zip(METRICS, WEIGHTS)) + " + 50) / 100.0) as bigint)"
    lost = lambda m: f"case when loser = 'graph' then g_{m} else v_{m} end"
    metrics = f"""{cells(q)},
    words as (select *, {tokens(q, "g_text")} as g_words, {tokens(q, "v_text")} as v_words, {plain(q, "g_text")} as g_plain, {plain(q, "v_text")} as v_plain,
           {tokens(q, "g_answer")} as g_tok, {tokens(q, "v_answer")} as v_tok from both_sides),
    metrics as (select id, query_class, question, truth, source_fields, expected, t_tok, gold, g_answer, v_answer, g_ctx, v_ctx, g_latency, v_latency, {side("g")}, {side("v")} from words)"""
    losers = f"""{q.once("metrics", metrics)},
    totals as (select *, {total("g")} as graph_score, {total("v")} as vector_score from metrics),
    won as (select *, case when graph_score < 3500 and vector_score < 3500 then 'neither' when abs(graph_score - vector_score) <= 500 then 'tie' when graph_score > vector_score then 'graph' else 'vector' end as winner from totals),
    losers as (select *, case when winner = 'graph' then 'vector' when winner = 'vector' then 'graph' when graph_score <= vector_score then 'graph' else 'vector' end as loser from won)"""
    return f"""{q.once("losers", losers)},
    results as (select *, case when winner = 'tie' then 'both_correct_or_tie' when {lost("entity_recall")} < 5000 then 'retrieval_missed_entities' when {lost("context_precision")} < 4000 then 'low_context_precision'
           when {lost("faithfulness")} < 5000 then 'unfaithful_answer' when {lost("answer_relevancy")} < 5000 then 'irrelevant_or_dodged_answer' else 'incomplete_synthesis' end as failure_mode from losers)"""


def shown(x: str, name: str) -> str:
    """A column of ten-thousandths as a number."""
    return f"cast({x} as double) / 10000 as {name}"


def o9_rows(q: Dialect) -> str:
    """Row-level results of both systems: five metrics each, composite scores, winner and failure mode."""
    out = [shown(f"{p}_{m}", f"{n}_{m}") for p, n in (("g", "graph"), ("v", "vector")) for m in METRICS]
    return f"with {scores(q)} select id, query_class, {', '.join(out)}, {shown('graph_score', 'graph_score')}, {shown('vector_score', 'vector_score')}, winner, failure_mode from results"


def mean4(q: Dialect, x: str) -> str:
    """The mean of whole ten-thousandths, to four decimals."""
    return f"cast({q.ratio4(f'sum({x})', 'greatest(1, count(*)) * 10000')} as double) / 10000"


def rate4(q: Dialect, condition: str) -> str:
    return f"cast({q.ratio4(q.count_if(condition), 'greatest(1, count(*))')} as double) / 10000"


def g1_class_summary(q: Dialect) -> str:
    """Per query class: rows, outcomes, win rates and mean metrics."""
    means = ", ".join(f"{mean4(q, f'{p}_{m}')} as {n}_{m}" for p, n in (("g", "graph"), ("v", "vector")) for m in METRICS[:4])
    wins = ", ".join(f"""{q.count_if(f"winner = '{w}'")} as {w}_rows""" for w in ("graph", "vector", "tie", "neither"))
    return f"""with {scores(q)} select query_class, count(*) as n_rows, {wins}, {rate4(q, "winner = 'graph'")} as graph_win_rate, {rate4(q, "winner = 'vector'")} as vector_win_rate, {means} from results group by query_class"""


def g2_global(q: Dialect) -> str:
    """One row over all questions: outcomes, rates, hard classes, mean scores."""
    hard = "query_class in (" + ", ".join(map(quote, HARD)) + ")"
    return f"""with {scores(q)} select count(*) as n_rows, {q.count_if("winner = 'graph'")} as graph_wins, {q.count_if("winner = 'vector'")} as vector_wins, {q.count_if("winner = 'tie'")} as ties,
    {q.count_if(hard)} as hard_rows, {q.count_if(hard + " and winner = 'graph'")} as hard_graph_wins, {mean4(q, "graph_score")} as graph_score, {mean4(q, "vector_score")} as vector_score from results"""


def g3_metric_win(q: Dialect) -> str:
    """Win rates by metric, for each class and over all, in one pass of grouping sets."""
    pairs = " union all ".join(f"select query_class, '{m}' as metric, g_{m} - v_{m} as delta from results" for m in METRICS)
    return f"""with {scores(q)}, deltas as ({pairs}) select query_class, metric, count(*) as n_rows, {q.count_if("delta > 500")} as graph_wins, {q.count_if("delta < -500")} as vector_wins, {q.count_if("abs(delta) <= 500")} as ties,
    grouping(query_class) as over_all from deltas group by grouping sets ((query_class, metric), (metric))"""


def g5_pivot(q: Dialect) -> str:
    """Class by winner, as columns."""
    return f"""with {scores(q)} select query_class, {", ".join(f"cast(coalesce(sum(case when winner = '{w}' then 1 end), 0) as bigint) as {w}" for w in ("graph", "vector", "tie", "neither"))} from results group by query_class"""


def g16_argmax(q: Dialect) -> str:
    """The most frequent failure of each class, ties to the smaller name."""
    return f"""with {scores(q)}, counted as (select query_class, failure_mode, count(*) as n from results where failure_mode <> 'both_correct_or_tie' group by query_class, failure_mode),
    ranked as (select *, row_number() over (partition by query_class order by n desc, failure_mode) as k from counted) select query_class, failure_mode, n from ranked where k = 1"""


def o10_hits(q: Dialect) -> str:
    """Retrieval hit, miss or uncertain by the best overlap of a context with the truth."""
    top = lambda p: f"coalesce({'array' if q.spark else 'list'}_max({q.map(p + '_ctx', 'c', q.ratio4(q.size(q.common(tokens(q, 'c'), 't_tok')), 'greatest(1, ' + q.size('t_tok') + ')'))}), 0)"
    label = lambda x: f"case when {x} >= 4000 then 'hit' when {x} <= 2000 then 'miss' else 'uncertain' end"
    return f"""with {cells(q)}, tops as (select id, {top("g")} as g_best, {top("v")} as v_best from both_sides)
    select id, {shown("g_best", "graph_overlap")}, {label("g_best")} as graph_hit, {shown("v_best", "vector_overlap")}, {label("v_best")} as vector_hit from tops"""


def g22_recall(q: Dialect) -> str:
    """Recall strict, without the uncertain, and the uncertain rate."""
    return f"""with h as ({o10_hits(q)}) select count(*) as n_rows, {q.count_if("graph_hit = 'hit'")} as hits, {q.count_if("graph_hit = 'miss'")} as misses, {rate4(q, "graph_hit = 'hit'")} as recall_strict, {rate4(q, "graph_hit = 'uncertain'")} as uncertain_rate from h"""


def o11_coverage(q: Dialect) -> str:
    """Graph coverage: half entities, three tenths field signals, two tenths relation-like contexts."""
    share = lambda n, d: f"case when {d} = 0 then 10000 else {q.ratio4(n, f'greatest(1, {d})')} end"
    fields = q.map(q.strings("coalesce(source_fields, '')"), "f", plain(q, "replace(f, '_', ' ')"))
    rel = q.size(q.filter("g_ctx", "c", q.like("lower(c)", r"(^|[^a-z0-9_])(related|compatible_with|connects_to|part_of|used_for|requires|supports|works with|compatible with|connects to|part of|used for)([^a-z0-9_]|$)")))
    hits = lambda a: q.size(q.filter(a, "s", found(q, "s", "g_plain", "g_words")))
    return f"""with {cells(q)}, w as (select *, {tokens(q, "g_text")} as g_words, {plain(q, "g_text")} as g_plain, {parts(q, q.distinct(fields))} as rel_parts from both_sides),
    parts as (select id, {share(hits("expected_parts"), q.size("expected"))} as ent, {share(hits("rel_parts"), q.size("rel_parts"))} as rel, case when {q.size("g_ctx")} = 0 then 0 else {q.ratio4(rel, "greatest(1, " + q.size("g_ctx") + ")")} end as dens from w)
    select id, {shown("ent", "entity_coverage")}, {shown("rel", "relation_coverage")}, {shown("dens", "structural_density")}, cast(floor((5 * ent + 3 * rel + 2 * dens + 5) / 10.0) as bigint) as coverage from parts"""


def o12_interpret(q: Dialect) -> str:
    """Losses of the graph system split at the median coverage."""
    return f"""with c as ({o11_coverage(q)}), r as ({o9_rows(q)}), m as (select {q.percentile("coverage", 0.5)} as mid from c)
    select r.id, r.winner, c.coverage, case when r.winner <> 'vector' then 'no_loss' when c.coverage < (select mid from m) then 'coverage_gap' else 'reasoning_gap' end as reading from r join c on r.id = c.id"""


def o13_contain(q: Dialect) -> str:
    """Which system's answer contains the truth or is contained in it."""
    norm = lambda x: "trim(" + q.sub(f"lower({x})", "[^a-z0-9]+", " ") + ")"
    ok = lambda a: f"({a} <> '' and t <> '' and (contains({a}, t) or contains(t, {a})))"
    return f"""with {cells(q)}, n as (select id, {norm("truth")} as t, {norm("g_answer")} as g, {norm("v_answer")} as v from joined)
    select id, case when {ok("g")} and {ok("v")} then 'tie' when {ok("g")} then 'graph' when {ok("v")} then 'vector' else 'neither' end as better from n"""


def q1_audit(q: Dialect) -> str:
    """Output quality of every question and system, with flags."""
    side = lambda p, n: f"""select id, query_class, '{n}' as system, {strip(q, p + "_answer")} as answer, {p}_ctx as ctx, {p}_has as has_row from audited"""
    bad = " or ".join(f"contains(lower(answer), {quote(e)})" for e in ERRORS)
    lost = f"(contains(lower(answer), {quote(NOT_FOUND)}) or lower(answer) in ('not found', 'i do not know', 'i don''t know'))"
    squeezed = q.map("ctx", "c", "trim(" + q.sub("lower(c)", r"\s+", " ") + ")")
    flag = lambda c, n: f"case when {c} then '{n}' end"
    return f"""with {cells(q)}, audited as (select joined.*, g.id is not null as g_has, v.id is not null as v_has from joined left join g on joined.id = g.id left join v on joined.id = v.id),
    rows_ as ({side("g", "graph")} union all {side("v", "vector")}),
    marked as (select *, answer = '' as answer_empty, {bad} as answer_error, {lost} as answer_not_found, {q.size("ctx")} as context_count, {q.size("ctx")} - {q.size(q.distinct(squeezed))} as duplicate_context_count from rows_)
    select id, query_class, system, answer_empty, answer_error, answer_not_found, not has_row as missing_prediction, context_count, duplicate_context_count, {q.chars("answer")} as answer_length_chars,
    concat_ws(';', {flag("not has_row", "missing_prediction")}, {flag("answer_empty", "answer_empty")}, {flag("answer_error", "answer_error")}, {flag("answer_not_found", "answer_not_found")}, {flag("context_count = 0", "context_empty")}, {flag("duplicate_context_count > 0", "duplicate_contexts")}) as quality_flags from marked"""


def q2_quality(q: Dialect) -> str:
    """Quality of each system."""
    return f"""with a as ({q1_audit(q)}) select system, count(*) as n_rows, {q.count_if("answer_empty")} as empty_answers, {q.count_if("answer_error")} as errors, {q.count_if("missing_prediction")} as missing, {q.count_if("context_count = 0")} as no_context, {rate4(q, "quality_flags = ''")} as clean_rate from a group by system"""


def g21_flags(q: Dialect) -> str:
    """How often each flag stands in the flag lists."""
    return f"""with a as ({q1_audit(q)}), f as (select system, {q.explode(q.split("quality_flags", ";"))} as flag from a where quality_flags <> '') select system, flag, count(*) as n from f group by system, flag"""


def q3_queue(q: Dialect) -> str:
    """Questions to review, with their reasons."""
    flag = lambda c, n: f"case when {c} then {n} end"
    hard = ", ".join(map(quote, HARD))
    return f"""with {scores(q)}, reasons as (select id, query_class, winner, concat_ws(';', {flag("winner = 'neither'", "'neither_system_won'")}, {flag(f"query_class in ({hard}) and winner = 'vector'", "'vector_won_hard_query'")},
    {flag("g_entity_recall >= 7500 and g_answer_correctness < 4000", "'graph_retrieved_entities_but_answer_weak'")}, {flag("failure_mode in ('retrieval_missed_entities', 'low_context_precision', 'unfaithful_answer', 'irrelevant_or_dodged_answer')", "failure_mode")}) as review_reasons from results)
    select id, query_class, winner, review_reasons from reasons where review_reasons <> ''"""


def q4_difficulty(q: Dialect) -> str:
    """Difficulty score and band of every question."""
    case = "case query_class " + " ".join(f"when '{k}' then {v}" for k, v in POINTS.items()) + " else 1 end"
    one = lambda c: f"case when {c} then 1 else 0 end"
    return f"""with {cells(q)}, p as (select id, query_class, {case} + {one(q.size("expected") + " >= 2")} + {one(q.size(q.strings("coalesce(source_fields, '')")) + " >= 2")} + {one(q.size("gold") + " >= 2")} + {one(q.size("t_tok") + " >= 24")} as points from both_sides),
    s as (select id, query_class, cast(greatest(1, least(5, 1 + points)) as bigint) as difficulty_score from p)
    select *, case when difficulty_score <= 2 then 'easy' when difficulty_score = 3 then 'medium' when difficulty_score = 4 then 'hard' else 'very_hard' end as difficulty_band from s"""


def q5_disagree(q: Dialect) -> str:
    """Where containment and the composite score name different winners."""
    return f"""with a as ({o13_contain(q)}), r as ({o9_rows(q)}) select a.id, r.winner, a.better, case when r.winner = a.better then 'agree' when r.winner in ('tie', 'neither') or a.better in ('tie', 'neither') then 'partial' else 'disagree' end as verdict from a join r on a.id = r.id"""


def q6_cost(q: Dialect) -> str:
    """Latency, token estimate and cost of each model."""
    return f"""with p as (select distinct id, model_name, coalesce(answer, '') as answer, latency_ms from {q.t("predictions")}), t as (select model_name, latency_ms, greatest(1, cast(floor(length(answer) / 4.0) as bigint)) as tok from p)
    select model_name, count(*) as n_rows, cast(sum(coalesce(latency_ms, 0)) as bigint) as latency_ms, cast(sum(tok) as bigint) as est_tokens, round(cast(sum(tok) as double) / 1000000 * 0.5, 8) as est_cost from t group by model_name"""


def stat1_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of both systems' win rates, of the score delta and of the five metrics by class, from 1000 resamples; small classes are reported as insufficient."""
    out = [f"{p}_{m}" for p in ("graph", "vector") for m in METRICS]
    rows = spark_query(o9_rows)(spark, d).where("query_class is not null")
    rows = rows.selectExpr("query_class", "cast(winner = 'graph' as int) as graph_win_rate", "cast(winner = 'vector' as int) as vector_win_rate", "graph_score - vector_score as score_delta", *out)
    return bootstrap(rows, "query_class", ["graph_win_rate", "vector_win_rate", "score_delta", *out])


def stat2_counts(q: Dialect) -> str:
    """Classes whose intervals are given and those with too few rows."""
    return f"""with r as ({o9_rows(q)}), n as (select query_class, count(*) as n_rows from r where query_class is not null group by query_class)
    select case when n_rows < 5 then 'insufficient_n_for_ci' else 'ok' end as status, count(*) as classes, cast(sum(n_rows) as bigint) as n_rows from n group by case when n_rows < 5 then 'insufficient_n_for_ci' else 'ok' end"""


def p3_kappa(q: Dialect) -> str:
    """Cohen's kappa of the two winner rules."""
    return f"""with a as ({q5_disagree(q)}), n as (select count(*) as n, sum(case when winner = better then 1 else 0 end) as same from a), l as (select winner as label, count(*) as c, 0 as d from a group by winner union all select better, 0, count(*) from a group by better),
    m as (select label, sum(c) as c, sum(d) as d from l group by label), e as (select cast(sum(c * d) as double) as e from m)
    select round((cast(same as double) / n - e / n / n) / nullif(1 - e / n / n, 0), 6) as kappa, n as n_rows from (select n, same, (select e from e) as e from n) x"""


def b2_context_texts(q: Dialect) -> str:
    """The context texts of every prediction, joined."""
    return f"select distinct id, model_name, {q.join(contexts(q, 'retrieved_contexts'), ' | ')} as texts, {q.size(contexts(q, 'retrieved_contexts'))} as n from {q.t('predictions')}"


def e5_signals(q: Dialect) -> str:
    """The expected signals of every question, joined."""
    return f"select distinct id, {q.join(q.sort(signals(q, 'source_product', 'source_fields')), ' | ')} as signals from {q.t('autoq_questions')}"


def f1_left_merge(q: Dialect) -> str:
    """Questions left joined to both systems' predictions."""
    return f"with {cells(q)} select id, query_class, g_answer, v_answer, g_latency, v_latency from joined"


def b16_bad_json(q: Dialect) -> str:
    """Ids whose contexts are no JSON array."""
    return f"select distinct id from {q.t('autoq_questions')} where coalesce(contexts, '') <> '' and {q.size(q.strings('contexts'))} = 0 and replace(contexts, ' ', '') <> '[]'"


def b17_ref_check(q: Dialect) -> str:
    """Ids on one side only: questions without prediction, predictions without question."""
    a, p = f"(select distinct id from {q.t('autoq_questions')})", f"(select distinct id from {q.t('predictions')})"
    return f"select a.id, 'missing' as side from {a} a left join {p} p on a.id = p.id where p.id is null union all select p.id, 'extra' as side from {p} p left join {a} a on a.id = p.id where a.id is null"


def b15_dup_ids(q: Dialect) -> str:
    """Ids that occur more than once."""
    return f"select id, count(*) as n from {q.t('autoq_questions')} where id is not null and trim(id) <> '' group by id having count(*) > 1"


def r3_convert(q: Dialect) -> str:
    """Benchmark rows: the question's parts that a retrieval run needs."""
    return f"select distinct id, {strip(q, "coalesce(question, '')")} as question, {strip(q, "coalesce(ground_truth, '')")} as answer, {q.join(q.strings('coalesce(source_fields, ' + chr(39) * 2 + ')'), '|')} as fields from {q.t('autoq_questions')}"


DUAL = [o9_rows, g1_class_summary, g2_global, g3_metric_win, g5_pivot, g16_argmax, o10_hits, g22_recall, o11_coverage, o12_interpret, o13_contain, q1_audit, q2_quality, g21_flags, q3_queue, q4_difficulty, q5_disagree, q6_cost, p3_kappa, b2_context_texts, e5_signals, f1_left_merge, b16_bad_json, b17_ref_check, b15_dup_ids, r3_convert]
QUERIES, ORACLES = both({f.__name__: f for f in DUAL} | {"stat2_counts": stat2_counts, "stat3_kappa": p3_kappa})
QUERIES["stat1_bootstrap"] = stat1_bootstrap
# Names that begin with p and a number belong to the data-preparation problems.
for _named in (QUERIES, ORACLES):
    _named.pop("p3_kappa")
