"""Lenient parsing, validation, line rules and set operations in both dialects.

Raw model output stands in the tables as contexts and answer texts; where a query needs broken JSON it is made from
them by a stated rule (a fence around it, text before it, a cut end), so that every branch of a parser is met.
"""

from __future__ import annotations

from tessella.plans.dialect import Dialect, both, quote
from tessella.plans.evaluate import HARD, contexts
from tessella.plans.texts import HEADERS, docs

FENCE = "```"
# Relation names, their aliases, stop words of the overlap set, spellings of winners and of truth values.
RELATIONS = "supports_protocol requires_voltage has_component compatible_with installed_with communicates_with indicates_fault configured_by monitors controls".split()
RELATION_ALIASES = {"supports": "supports_protocol", "uses_protocol": "supports_protocol", "requires": "requires_voltage", "requires_power": "requires_voltage", "operates_at_voltage": "requires_voltage", "contains": "has_component", "includes": "has_component", "has": "has_component", "compatible": "compatible_with", "connects_to": "installed_with", "wired_to": "installed_with", "indicates": "indicates_fault"}
SMALL_WORDS = "a an the is are was were be been being have has had do does did will would could should may might shall can need of in on at to for with by from up about into through and or but not if as it its this that these those".split()
REQUIRED = {"autoq_questions": ["id", "question", "ground_truth", "contexts", "category", "query_class", "reasoning_type"], "predictions": ["id", "answer", "retrieved_contexts", "score"]}


def raw(q: Dialect) -> str:
    """CTE raw: (id, text), the output a model might have given about a question: an object, fenced, after a sentence, cut off, or none."""
    obj = "concat('{\"winner\": \"', coalesce(query_class, 'tie'), '\", \"score\": ', cast(length(question) % 5 + 1 as varchar(2)), ', \"rationale\": \"r', id, '\"}')"
    return f"""base as (select id, min(question) as question, min(query_class) as query_class, min(ground_truth) as truth from {q.t("autoq_questions")} where id is not null and question is not null group by id),
    raw as (select id, case length(question) % 5 when 0 then {obj} when 1 then concat('{FENCE}json', {q.nl}, {obj}, {q.nl}, '{FENCE}') when 2 then concat('Here it is: ', {obj}, ' as asked.') when 3 then substr({obj}, 1, length({obj}) - 3) else coalesce(truth, '') end as text from base)"""


def b3_objects(q: Dialect) -> str:
    """How many contexts of a prediction are objects and how many of those have a text."""
    cells = q.strings("retrieved_contexts")
    return f"select distinct id, model_name, {q.size(q.filter(cells, 'e', 'substr(e, 1, 1) = chr(123)'))} as objects, {q.size(q.filter(cells, 'e', 'case when substr(e, 1, 1) = chr(123) then ' + q.field('e', 'text') + ' is not null else false end'))} as with_text from {q.t('predictions')}"


def lenient(q: Dialect, text: str) -> str:
    """The JSON object in a text: the whole of it, else from the first brace to the last; null if it does not parse."""
    inner = q.group(text, r"(?s)(\{.*\})")
    return q.valid_object(text, inner)


def b4_lenient_object(q: Dialect) -> str:
    """Fields of the JSON object that stands somewhere in a text."""
    return f"with {raw(q)}, o as (select id, {lenient(q, 'text')} as o from raw) select id, {q.field('o', 'winner')} as winner, try_cast({q.field('o', 'score')} as bigint) as score, {q.field('o', 'rationale')} as rationale from o"


def b5_near_json(q: Dialect) -> str:
    """Score and rationale read by pattern where the object does not parse, as when it is cut off."""
    score = f"nullif({q.group('text', '\"score\"\\\\s*:\\\\s*([0-9]+)')}, '')"
    why = f"nullif({q.group('text', '\"rationale\"\\\\s*:\\\\s*\"([^\"]*)')}, '')"
    return f"with {raw(q)}, o as (select id, text, {lenient(q, 'text')} as o from raw) select id, coalesce(try_cast({q.field('o', 'score')} as bigint), try_cast({score} as bigint)) as score, coalesce({q.field('o', 'rationale')}, {why}) as rationale, o is null as recovered from o"


def b6_lenient_list(q: Dialect) -> str:
    """A list in any form: a JSON array, else the lines without bullets, numbers and quotes."""
    lines = q.filter(q.map(q.split("text", chr(10)), "x", q.sub(q.sub("trim(x)", "^[-*•]*[ \\t]*[0-9. )(]*", ""), "^[\"' ]+|[\"' ]+$", "")), "x", "x <> ''")
    return f"""with s as (select distinct record_id, case when length(field_value) % 2 = 0 then concat('["', replace(replace(field_value, '"', ''), '|', '", "'), '"]') else concat('- ', replace(replace(field_value, '"', ''), '|', concat({q.nl}, '2. '))) end as text from {q.t("product_records")} where field_name in (select field_name from {q.t("field_catalog")} where value_type = 'list') and field_value is not null and not contains(field_value, chr(92)) and not contains(field_value, {q.nl}) and not contains(field_value, chr(9)))
    select record_id, {q.join(f"case when {q.size(q.strings('text'))} > 0 then {q.filter(q.map(q.strings('text'), 'x', 'trim(x)'), 'x', 'x <> chr(32) and length(x) > 0')} else {lines} end", "|")} as items from s"""


def b7_fences(q: Dialect) -> str:
    """Texts without code fences around them."""
    return f"with {raw(q)} select id, trim({q.sub(q.sub('trim(text)', '^' + FENCE + '[a-zA-Z]*\\\\n?', ''), '\\\\n?' + FENCE + '$', '')}) as bare from raw"


def b8_project(q: Dialect) -> str:
    """Tolerant projection: columns that exist under their new names, missing ones null."""
    return f"select distinct id, answer as predicted_answer, latency_ms as latency, cast(null as varchar(10)) as score, model_name from {q.t('predictions')}"


def b9_pass_through(q: Dialect) -> str:
    """Results beside all columns of the question."""
    return f"select distinct q.id, q.category, q.query_class, q.reasoning_type, q.source_product, q.source_split, q.generation_method, p.model_name, length(p.answer) as answer_length from {q.t('autoq_questions')} q join {q.t('predictions')} p on q.id = p.id"


def b11_excluded(q: Dialect) -> str:
    """Named nodes none of whose labels is one of the infrastructure."""
    labels = q.array("coalesce(record_type, 'none')", "coalesce(section_header, 'none')")
    infra = ["Chunk", "Document", "Features", "none"]
    hit = q.size(q.filter(labels, "x", "x in (" + ", ".join(map(quote, infra)) + ")"))
    return f"select distinct record_id from {q.t('product_records')} where product_name is not null and {hit} = 0"


def b13_optional(q: Dialect) -> str:
    """Several optional criteria at once; `All` sets no condition."""
    chosen = {"query_class": "multi_hop", "category": "All", "generation_method": "All"}
    where = " and ".join(f"{c} = {quote(v)}" for c, v in chosen.items() if v != "All")
    return f"select distinct id, query_class, category from {q.t('autoq_questions')} where {where}"


def b14_columns(q: Dialect) -> str:
    """Required columns that a table lacks."""
    return " union all ".join(f"select '{t}' as table_name, '{c}' as missing from (select count(*) as n from {q.t(t)}) x where n >= 0 and not {str(c in COLUMNS[t]).lower()}" for t, cs in REQUIRED.items() for c in cs)


#: The columns of the checked tables, as TESTDATA.md gives them.
COLUMNS = {"autoq_questions": "id question ground_truth contexts category query_class reasoning_type source_product source_fields source_split generation_method support_notes".split(), "predictions": "id answer retrieved_contexts latency_ms model_name run_id timestamp_utc".split()}


def b18_violations(q: Dialect) -> str:
    """All violations of the inputs in the order of the checks: missing columns, blank and repeated ids, broken JSON, ids on one side only."""
    a, p = f"(select distinct id from {q.t('autoq_questions')})", f"(select distinct id from {q.t('predictions')})"
    bad = f"coalesce(contexts, '') <> '' and {q.size(q.strings('contexts'))} = 0 and replace(contexts, ' ', '') <> '[]'"
    return f"""select 1 as step, 'missing_column' as kind, concat(table_name, '.', missing) as what from ({b14_columns(q)}) m
    union all select 2, 'blank_id', '' from {q.t("autoq_questions")} where id is null or trim(id) = ''
    union all select 3, 'duplicate_id', id from {q.t("autoq_questions")} where id is not null group by id having count(*) > 1
    union all select 4, 'broken_contexts', id from (select distinct id, contexts from {q.t("autoq_questions")}) b where {bad}
    union all select 5, 'missing_prediction', a.id from {a} a left join {p} p on a.id = p.id where p.id is null
    union all select 5, 'extra_prediction', p.id from {p} p left join {a} a on a.id = p.id where a.id is null"""


def b19_row_count(q: Dialect) -> str:
    """Whether a join kept the rows of its left side: ids, rows after the join with repeated predictions, and after the join with one per id and model."""
    ids = f"(select distinct id from {q.t('autoq_questions')})"
    return f"""select (select count(*) from {ids} a) as expected, (select count(*) from {ids} a left join {q.t("predictions")} p on a.id = p.id and p.model_name = 'graph_walk') as fanned_out,
    (select count(*) from {ids} a left join (select distinct id from {q.t("predictions")} where model_name = 'graph_walk') p on a.id = p.id) as kept"""


def b21_enums(q: Dialect) -> str:
    """Free spellings in one of a set of values: categories as winners, yes and no as truth values."""
    low = f"{q.sub('lower(trim(field_value))', '[^a-z0-9]+', '_')}"
    true, false = ["yes", "y", "true", "1", "supported"], ["no", "n", "false", "0", "not_supported"]
    return f"select distinct field_value, case when {low} in ({', '.join(map(quote, true))}) then 'true' when {low} in ({', '.join(map(quote, false))}) then 'false' when {low} in ('uncertain', 'unknown', 'tbd') then 'uncertain' else 'other' end as value from {q.t('product_records')} where field_value is not null"


def b27_contexts(q: Dialect) -> str:
    """A contexts cell as a list: a JSON array, else the raw text as its only element; blank cells have none."""
    return f"select distinct id, case when {q.size(q.strings('contexts'))} > 0 then {q.size(q.strings('contexts'))} when coalesce(trim(contexts), '') in ('', '[]') then 0 else 1 end as n from {q.t('autoq_questions')}"


def b28_lists(q: Dialect) -> str:
    """Length of a list cell, and of it without blank members; what is no list has none."""
    cells = q.strings("coalesce(source_fields, '')")
    return f"select distinct id, {q.size(cells)} as n, {q.size(q.filter(q.map(cells, 'x', 'trim(x)'), 'x', 'length(x) > 0'))} as filled from {q.t('autoq_questions')}"


def c4_small_words(q: Dialect) -> str:
    """Distinct words without small words, of any length."""
    return f"select distinct id, {q.join(q.sort(q.distinct(q.words('question', SMALL_WORDS, 0))), ' ')} as words from {q.t('autoq_questions')} where question is not null"


def lines_of(q: Dialect) -> str:
    """CTE l: the lines of every document."""
    return f"l as (select doc_id, {q.positions('ls', 'pos', 'line')} from (select doc_id, {q.split('text', chr(10))} as ls from {docs(q)} d) x)"


def c12_headings(q: Dialect) -> str:
    """Lines that name a product: they hold a code, or are two to seven words mostly in capitals."""
    upper, letters = f"length({q.sub('line', '[^A-Z]', '')})", f"length({q.sub('line', '[^A-Za-z]', '')})"
    n = q.size(q.find("line", "[A-Za-z0-9]+"))
    code = q.like("line", r"(^|[^A-Za-z0-9_])([A-Z]{1,4}-[A-Z0-9]{2,}|[A-Z]{1,4}[0-9]+[A-Z0-9-]*)([^A-Za-z0-9_]|$)")
    return f"with {lines_of(q)} select doc_id, cast(pos as bigint) as pos, {code} as has_code from l where trim(line) <> '' and not {q.like('line', '^[ \\t]*-')} and ({code} or ({n} between 2 and 7 and {letters} > 0 and {upper} > 0.75 * {letters}))"


def c14_lines(q: Dialect) -> str:
    """Lines with one blank between words, none around slashes and inside brackets, units in one form."""
    t = "replace(replace(replace(" + q.sub("trim(line)", "[ \\t\\r]+", " ") + ", ' / ', '/'), '( ', '('), ' )', ')')"
    t = q.sub(t, r"([0-9]) ?V ?(DC|dc)([^A-Za-z]|$)", "\\1 VDC\\3")
    t = q.sub(t, r"([0-9]) *(V|W|Hz)([^A-Za-z]|$)", "\\1 \\2\\3")
    return f"with {lines_of(q)} select doc_id, cast(pos as bigint) as pos, {t} as line from l where trim(line) <> ''"


def c16_meaningful(q: Dialect) -> str:
    """Lines that carry meaning: a digit or a word of the domain, or a quarter of letters."""
    letters = f"length({q.sub('line', '[^A-Za-z]', '')})"
    cue = q.like("lower(line)", "[0-9]|candela|voltage|power|input|output|zones?|speaker|strobe|hotel|warehouse|school|stadium|restaurant")
    return f"with {lines_of(q)} select doc_id, count(*) as n_lines, {q.count_if(f'length(trim(line)) >= 3 and ({cue} or 4 * {letters} >= length(trim(line)))')} as meaningful from l group by doc_id"


def c20_block_type(q: Dialect) -> str:
    """The kind of block that a section header begins."""
    h = "lower(line)"
    rule = f"case when contains({h}, 'spec') or contains({h}, 'electrical') or contains({h}, 'mechanical') then 'specification' when contains({h}, 'feature') or contains({h}, 'benefit') then 'features' when contains({h}, 'install') or contains({h}, 'instruction') then 'procedure' else 'general' end"
    return f"with {lines_of(q)} select {rule} as block_type, count(*) as n from l where {q.like('lower(line)', HEADERS)} group by {rule}"


def c31_relation(q: Dialect) -> str:
    """Relation names in snake case, by alias, empty if not allowed; from the field names of records."""
    snake = q.sub(q.sub("lower(trim(n))", "[^a-z0-9]+", "_"), "^_+|_+$", "")
    alias = "case r " + " ".join(f"when '{k}' then '{v}'" for k, v in RELATION_ALIASES.items()) + " else r end"
    allowed = ", ".join(map(quote, RELATIONS))
    extra = " union all ".join(f"select {quote(n)} as n" for n in ["Supports", "wired to", "Has", "MONITORS!", "unknown thing"])
    return f"with n as (select distinct field_name as n from {q.t('product_records')} where field_name is not null union all {extra}), s as (select n, {snake} as r from n), a as (select n, {alias} as r from s) select n as name, case when r in ({allowed}) then r else '' end as relation from a"


def c32_relation_text(q: Dialect) -> str:
    """Parts of a rendered relation `source -[name ...]-> target`, rendered here from records."""
    text = "concat(product_name, ' -[', field_name, ' {c: 1}]-> ', field_value)"
    pattern = r"^\s*(.*?)\s*-\[\s*([^\s\]]+)[^\]]*\]->\s*(.*?)\s*$"
    return f"""with t as (select distinct record_id, {text} as t from {q.t("product_records")} where product_name is not null and field_name is not null and field_value is not null and not contains(field_value, {q.nl}) and not contains(field_name, ' ') and not contains(field_name, ']') and not contains(field_name, '[') and not contains(field_value, ']->'))
    select record_id, {q.group("t", pattern, 1)} as source, {q.group("t", pattern, 2)} as relation, {q.group("t", pattern, 3)} as target from t"""


def c44_evidence(q: Dialect) -> str:
    """Evidence texts with single blanks, at most 240 characters (the cut is the feature)."""
    return f"select distinct record_id, substr(trim({q.sub('evidence_text', '[ \\t\\r\\n]+', ' ')}), 1, 240) as evidence from {q.t('product_records')} where evidence_text is not null"


def c46_headers(q: Dialect) -> str:
    """Lines that are one of three headers, with or without a colon and text after it."""
    t = q.sub("lower(trim(line))", ":+$", "")
    return f"with {lines_of(q)} select doc_id, cast(pos as bigint) as pos from l where {t} in ('space use', 'land applications', 'specifications') or {q.like('lower(trim(line))', '^(space use|land applications|specifications):')}"


def h7_variance(q: Dialect) -> str:
    """Spread of the answers' lengths over the models of a question; one answer has none."""
    return f"select id, count(*) as variants, round(avg(n), 4) as mean, round(var_samp(n), 4) as variance, min(n) as least, max(n) as most from (select distinct id, model_name, cast(length(coalesce(answer, '')) as double) as n from {q.t('predictions')}) x group by id"


def i2_head(q: Dialect) -> str:
    """The ten newest documents."""
    return f"select doc_id, published_at from {q.t('source_documents')} where published_at is not null order by published_at desc, doc_id limit 10"


def i4_composite(q: Dialect) -> str:
    """The five best products of each platform by documents, then place, then name; those with documents first, all if none has."""
    return f"""with n as (select p.platform, p.product_name, count(d.doc_id) as score from {q.t("products")} p left join (select doc_id, product_name from {q.t("source_documents")} where doc_type = 'datasheet') d on p.product_name = d.product_name group by p.platform, p.product_name),
    r as (select *, row_number() over (partition by platform order by score desc, product_name desc) as k, max(score) over (partition by platform) as top from n) select platform, product_name, score, cast(k as bigint) as k from r where k <= 5 and (score > 0 or top = 0)"""


def i6_review(q: Dialect) -> str:
    """Events by band of confidence, then by value: a list for review."""
    band = "case when value >= 20 then 0 when value >= 5 then 1 else 2 end"
    return f"select event_id, {band} as band, value from {q.t('events')} where event_type = 'error' order by {band}, value desc, event_id"


def i7_smoke(q: Dialect) -> str:
    """A small subset for a smoke run: the first five questions of hard classes, or of all if there are none."""
    hard = "query_class in (" + ", ".join(map(quote, HARD)) + ")"
    return f"with u as (select distinct id, query_class from {q.t('autoq_questions')} where id is not null), m as (select max(case when {hard} then 1 else 0 end) as any_hard from u) select id, query_class from u where {hard} or (select any_hard from m) = 0 order by id limit 5"


def j2_rows(q: Dialect) -> str:
    """Rows of both systems and of the reference answers in one table, with their stage; columns that one lacks are null."""
    p = lambda m, s: f"select distinct id, '{s}' as stage, model_name, answer, latency_ms from {q.t('predictions')} where model_name = '{m}'"
    return f"{p('graph_walk', 'graph')} union all {p('dense_small', 'vector')} union all select distinct id, 'judge', cast(null as varchar(10)), ground_truth, cast(null as bigint) from {q.t('autoq_questions')}"


def j5_questions(q: Dialect) -> str:
    """Questions without repeats in lower case without outer blanks, the first id kept."""
    return f"select min(id) as id, lower(trim(question)) as question_key from {q.t('autoq_questions')} where question is not null group by lower(trim(question))"


def j7_priority(q: Dialect) -> str:
    """Contexts of a question by priority: those of the graph system, then those of the vector system, then its own; equal texts keep their first place."""
    part = lambda prio, sql: f"select id, {prio} as prio, {q.positions('ctx', 'pos', 'context')} from ({sql}) x{prio}"
    pred = lambda m: f"select distinct id, {contexts(q, 'retrieved_contexts')} as ctx from {q.t('predictions')} where model_name = '{m}'"
    own = f"select distinct id, {contexts(q, 'contexts')} as ctx from {q.t('autoq_questions')}"
    return f"""with u as ({part(1, pred("graph_walk"))} union all {part(2, pred("dense_small"))} union all {part(3, own)}),
    r as (select id, context, prio, pos, row_number() over (partition by id, context order by prio, pos) as k from u) select id, context, prio, cast(pos as bigint) as pos from r where k = 1"""


def j8_variants(q: Dialect) -> str:
    """The first three distinct wordings of each class, in lower case."""
    return f"""with d as (select query_class, lower(trim(ground_truth)) as wording, min(id) as id from {q.t("autoq_questions")} where ground_truth is not null and query_class is not null group by query_class, lower(trim(ground_truth))),
    r as (select *, row_number() over (partition by query_class order by id, wording) as k from d) select query_class, wording, id from r where k <= 3"""


DUAL = [f for n, f in dict(globals()).items() if n[:1] in "bchij" and n[1:2].isdigit()]
QUERIES, ORACLES = both({f.__name__: f for f in DUAL})
