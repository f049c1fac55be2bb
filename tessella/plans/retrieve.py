"""Lexical and hybrid retrieval over a corpus of sections, extractive answers and benchmark construction.

The corpus is the documents cut at their section headers. Searches take the questions whose id is divisible by 20, against
all sections; `f14_scores` and what works on a question's own predicted contexts take all questions. The scans run as
operators (`lexical`, `vectors`); their SQL is brute force over all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.answers import answer_lines
from tessella.operators.lexical import BOOSTS, CUE_PHRASES, QUESTION_PHRASES, QUESTION_TYPES, near_best, search
from tessella.operators.matching import contained
from tessella.operators.recordsearch import search_records
from tessella.operators.staged import staged
from tessella.plans.dialect import Dialect, SparkDialect, both, quote
from tessella.plans.evaluate import contexts, tokens
from tessella.plans.texts import BAG_STOP, HEADERS, any_of, docs, sentences
from tessella.session import keep, spread, table

QUERIES_OF = 20
# Product codes and numbers of a question.
CODE = r"\b(?:[A-Za-z]+-Series|[A-Z]{1,4}-[A-Z0-9]{2,}|[A-Z]-[A-Z0-9]{3,}|[A-Z]{1,4}\d+[A-Z0-9-]*)\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"


def corpus(q: Dialect) -> str:
    """CTE chunks: (chunk_id, doc_id, text, header, block, doc, doc_type), one row per section of a document."""
    block = "case when contains(header, 'spec') then 'specification' when contains(header, 'feature') then 'features' when contains(header, 'install') or contains(header, 'wiring') or contains(header, 'montage') then 'procedure' else 'general' end"
    return f"""cl as (select doc_id, {q.positions("ls", "pos", "line")} from (select doc_id, {q.split("text", chr(10))} as ls from {docs(q)} d) x),
    ch as (select doc_id, pos, line, case when {q.like("lower(line)", HEADERS)} then 1 else 0 end as is_header from cl),
    cs as (select *, sum(is_header) over (partition by doc_id order by pos rows between unbounded preceding and current row) as section from ch),
    cj as (select doc_id, cast(section as bigint) as section, {q.lines("pos", "line")} as text, lower(trim(coalesce(max(case when is_header = 1 then line end), ''))) as header from cs group by doc_id, section),
    chunks as (select concat(cast(c.doc_id as varchar(20)), '#', lpad(cast(section as varchar(10)), 4, '0')) as chunk_id, c.doc_id, text, header, {block} as block, lower(concat(cast(c.doc_id as varchar(20)), ' ', coalesce(m.product_name, ''))) as doc, coalesce(m.doc_type, '') as doc_type
           from cj c join (select doc_id, product_name, doc_type from {q.t("documents")}) m on c.doc_id = m.doc_id where trim(text) <> '')"""


def kind_of(question: str) -> str:
    return "case " + " ".join(f"when {any_of(question, terms)} then '{name}'" for name, terms in QUESTION_TYPES) + " else 'general' end"


def asked(q: Dialect, where: str = "true") -> str:
    """CTE asked: what each question looks for, computed once."""
    held = lambda phrases: q.filter(q.array(*map(quote, phrases)), "p", "contains(low_q, p)")
    return f"""aq as (select id, min(question) as question, lower(min(question)) as low_q from {q.t("autoq_questions")} where id is not null and question is not null and {where} group by id),
    asked as (select id, question, {q.distinct(q.filter(q.find("low_q", "[a-z0-9]+"), "w", "length(w) > 2"))} as words, {q.find("low_q", NUMBER)} as nums, {q.distinct(q.map(q.find("question", CODE), "x", "lower(x)"))} as prods,
           {kind_of("low_q")} as kind, {held(QUESTION_PHRASES)} as phrases, {held(CUE_PHRASES)} as cues, {held(list(BOOSTS))} as boosts from aq)"""


def keyword(q: Dialect, low: str) -> str:
    """Keyword score of a row with a question's parts and a text in lower case."""
    n = lambda a, test="contains({low}, w)": q.size(q.filter(a, "w", test.format(low=low)))
    strong = ", ".join(quote(p) for p, w in BOOSTS.items() if w == 10)
    boost = f"5 * {n('boosts')} + 5 * {n('boosts', 'contains({low}, w) and w in (' + strong + ')')}"
    missing = f"case when {q.size('prods')} > 0 and kind <> 'general' and {n('prods')} = 0 then 4 else 0 end"
    return f"cast({n('words')} + {boost} + 6 * {n('prods')} - {missing} as double) + 2.5 * {n('nums')}"


def lexical(q: Dialect, text: str, low: str, header: str, block: str, doc: str) -> str:
    """Lexical score of a row with a question's parts and a chunk's."""
    n = lambda a: q.size(q.filter(a, "w", f"contains({low}, w)"))
    whole = q.size(q.common(q.distinct("nums"), q.distinct(q.find(low, NUMBER))))
    bonus = f"""case when kind = 'single_numeric_spec' and ({block} = 'specification' or contains({header}, 'spec')) or kind = 'enumerated_settings' and (contains({low}, ',') or contains({low}, '/'))
    or kind = 'capacity' and (contains({low}, 'up to') or contains({low}, 'connected on a system')) or kind = 'usage' and (contains({low}, 'designed for') or contains({low}, 'locations such as')) then 3 else 0 end"""
    strict = f"case when kind in ('single_numeric_spec', 'enumerated_settings') and {q.size('phrases')} > 0 and {n('phrases')} = 0 then 10 else 0 end"
    away = f"case when {q.size('prods')} > 0 and {q.size(q.filter('prods', 'w', f'contains({low}, w) or contains({doc}, w)'))} = 0 then 6 else 0 end"
    return f"{keyword(q, low)} + 8 * {n('prods')} + 14 * {n('phrases')} + 5 * {n('cues')} + 3 * {whole} + {bonus} - {strict} - {away}"


def _pairs(q: Dialect) -> str:
    """CTE pairs: each question's parts with each of its predicted contexts, at its position."""
    return f"""{asked(q)}, p as (select distinct id, model_name, {contexts(q, "retrieved_contexts")} as ctx from {q.t("predictions")}),
    c as (select id, model_name, {q.positions("ctx", "pos", "context")} from p),
    pairs as (select asked.*, c.model_name, cast(c.pos as bigint) as pos, c.context, lower(c.context) as low from asked join c on asked.id = c.id)"""


def k3_keyword(q: Dialect) -> str:
    """Keyword score of every question and predicted context: words, phrases, codes, numbers, less 4 where no code is met."""
    return f"with {_pairs(q)} select id, model_name, pos, {keyword(q, 'low')} as score from pairs"


def k4_lexical(q: Dialect) -> str:
    """Lexical score of every question and predicted context."""
    empty = quote("")
    return f"with {_pairs(q)} select id, model_name, pos, cast({lexical(q, 'context', 'low', empty, empty, empty)} as double) as lexical from pairs"


def k6_rerank(q: Dialect) -> str:
    """The five best contexts of each question by the reranking provider, by default the keyword score."""
    return f"with s as ({k3_keyword(q)}), r as (select *, row_number() over (partition by id, model_name order by score desc, pos) as k from s) select id, model_name, pos, score, cast(k as bigint) as k from r where k <= 5"


def k8_hybrid(q: Dialect) -> str:
    """Final score of each context: similarity 1 / (1 + d) of its distance d (here its place in the list), lexical and keyword score; the three best."""
    return f"""with a as ({k3_keyword(q)}), b as ({k4_lexical(q)}), f as (select a.id, a.model_name, a.pos, round(1.0 / (1 + a.pos) + cast(0.35 as double) * b.lexical + cast(1.8 as double) * a.score, 6) as score from a join b on a.id = b.id and a.model_name = b.model_name and a.pos = b.pos),
    r as (select *, row_number() over (partition by id, model_name order by score desc, pos) as k from f) select id, model_name, pos, cast(score as double) as score, cast(k as bigint) as k from r where k <= 3"""


def k22_provenance(q: Dialect) -> str:
    """Sources of every context of a question over all models, with the similarity of its best place: one row per text."""
    return f"""with {_pairs(q)} select id, substr(context, 1, 120) as doc_key, count(distinct model_name) as sources, {q.join(q.collect("model_name"), "|")} as retriever_sources, round(max(cast(1 as double) / (1 + pos)), 6) as similarity from pairs group by id, substr(context, 1, 120)"""


def _bag(q: Dialect, x: str) -> str:
    return q.words(x, BAG_STOP, 1)


def _shared(q: Dialect, terms: str, words: str) -> str:
    """Multiset intersection: for each distinct term the smaller of both counts."""
    count = lambda a: q.size(q.filter(a, "z", "z = t"))
    total = q.map(q.distinct(terms), "t", f"least({count(terms)}, {count(words)})")
    return f"aggregate({total}, cast(0 as bigint), (s, v) -> s + v)" if q.spark else f"coalesce(cast(list_sum({total}) as bigint), 0)"


def _marked(q: Dialect) -> str:
    """CTE marked: each pair with its words, and the best sentence's score, the path and edge scores and the penalty of index-like texts."""
    short = q.size(q.find("substr(context, 1, 1200)", r"\b\d{1,3}\b"))
    best = f"{'array_max' if q.spark else 'list_max'}({q.map(sentences(q, 'context'), 's', _shared(q, 'terms', _bag(q, 's')))})"
    edges = f"select id, model_name, pos, least(count(*), 3) as edges from (select id, model_name, pos, {q.explode(q.distinct('prods'))} as e, low from pairs) x where contains(low, e) group by id, model_name, pos"
    return f"""{_pairs(q)}, bags as (select id, model_name, pos, context, {_bag(q, "question")} as terms, {_bag(q, "context")} as own, {q.filter(q.find("lower(" + q.join("prods", " ") + ")", "[a-z0-9]+"), "w", "length(w) > 1")} as path from pairs),
    edges as ({edges}),
    marked as (select b.id, b.model_name, b.pos, context, terms, own, coalesce({best}, 0) as best, {q.size(q.common(q.distinct("path"), q.distinct("own")))} as path_score, coalesce(e.edges, 0) as edges, case when contains(concat(' ', lower(substr(context, 1, 350)), ' '), ' index ') or {short} >= 35 then 0.25 else 1.0 end as penalty
           from bags b left join edges e on b.id = e.id and b.model_name = e.model_name and b.pos = e.pos)"""


def k17_rank(q: Dialect) -> str:
    """The five best supporting contexts: shared words, twice the best sentence's and the path's, edges up to 3, all by the penalty; those of score 0 only where all are."""
    return f"""with {_marked(q)}, s as (select id, model_name, pos, cast(({_shared(q, "terms", "own")} + 2 * best + 2 * path_score + edges) * penalty as double) as score from marked),
    r as (select *, row_number() over (partition by id, model_name order by score desc, pos) as k, max(score) over (partition by id, model_name) as top from s) select id, model_name, pos, score, cast(k as bigint) as k from r where k <= 5 and (score > 0 or top = 0)"""


def k18_extract(q: Dialect) -> str:
    """Extractive answer: the three sentences that share most words with the question, plus 1 / place, of the first five contexts; at most 700 characters."""
    return f"""with {_pairs(q)}, e as (select id, {_bag(q, "question")} as terms, model_name, pos, {q.positions(sentences(q, "context"), "place", "sentence")} from pairs where pos < 5),
    s as (select id, model_name, pos, place, sentence, round({_shared(q, "terms", _bag(q, "sentence"))} + cast(1 as double) / (place + 1), 9) as score from e),
    r as (select *, row_number() over (partition by id, model_name order by score desc, pos, place) as k from s),
    j as (select id, model_name, {q.lines("k", "sentence")} as joined from r where k <= 3 group by id, model_name) select id, model_name, substr(replace(joined, chr(10), ' '), 1, 700) as answer from j"""


def vector(q: Dialect, text: str, size: int = 64) -> str:
    """A text's word counts by hash bucket, the portable default of the embedding provider."""
    return q.map(q.map(q.find(f"lower({text})", "[a-z0-9]+"), "w", q.hash_int("w")), "h", f"h % {size}")


def k19_grounded(q: Dialect) -> str:
    """Attribution of every answer to its contexts: the greatest cosine of hashed word counts, the first context that has it, the contexts used and the state."""
    at = lambda a, b: q.map(a, "z", q.size(q.filter(b, "y", "y = z")))
    total = lambda a: f"cast(aggregate({a}, cast(0 as bigint), (s, v) -> s + v) as double)" if q.spark else f"coalesce(cast(list_sum({a}) as double), 0)"
    cos = f"case when {q.size('va')} = 0 or {q.size('vc')} = 0 then cast(0 as double) else {total(at('va', 'vc'))} / sqrt({total(at('va', 'va'))} * {total(at('vc', 'vc'))}) end"
    return f"""with p as (select distinct id, model_name, coalesce(answer, '') as answer, {contexts(q, "retrieved_contexts")} as ctx from {q.t("predictions")} where id is not null),
    one as (select id, model_name, min(answer) as answer, min({q.join("ctx", chr(2))}) as all_ctx from p group by id, model_name),
    v as (select id, model_name, {vector(q, "answer")} as va, {q.split("all_ctx", chr(2))} as ctx from one),
    e as (select id, model_name, va, {q.positions("ctx", "pos", "c")} from v), w as (select id, model_name, va, cast(pos as bigint) as pos, c, {vector(q, "c")} as vc from e),
    s as (select id, model_name, pos, c, round({cos} + cast(0.000000001 as double), 4) as sim from w),
    r as (select *, row_number() over (partition by id, model_name order by sim desc, pos) as k, sum(case when sim >= 0.75 then 1 else 0 end) over (partition by id, model_name) as used from s)
    select id, model_name, sim as max_chunk_sim, pos as best_chunk, cast(used as bigint) as used_chunks, substr(replace(c, chr(10), ' '), 1, 200) as top_chunk_text, case when sim >= 0.75 then 'used' when sim <= 0.4 then 'unused' else 'uncertain' end as state from r where k = 1"""


def k26_terms(q: Dialect) -> str:
    """Evidence terms of every question: its own words and those of the codes it names, with repeats."""
    return f"with {asked(q)} select id, {q.join(q.cat(_bag(q, 'question'), _bag(q, q.join(q.sort('prods'), ' '))), ' ')} as terms from asked"


def c5_query_terms(q: Dialect) -> str:
    """Words of a question but for generic ones."""
    generic = "what are the and for with from that this land applications application space use uses used".split()
    return f"with {asked(q)} select id, {q.join(q.sort(q.distinct(q.words('question', generic, 2))), ' ')} as terms from asked"


def c6_codes(q: Dialect) -> str:
    """Product codes named in a question."""
    return f"with {asked(q)} select id, {q.join(q.sort('prods'), '|')} as codes from asked"


def c10_requested(q: Dialect) -> str:
    """Section and type of document that a question asks for, by ordered rules."""
    low = "lower(question)"
    return f"""with {asked(q)} select id, case when contains({low}, 'land application') then 'land applications' when contains({low}, 'space use') then 'space use' when {any_of(low, ["spec", "rating", "voltage"])} then 'specifications' end as section,
    case when {any_of(low, ["install", "how to"])} then 'installation' when {any_of(low, ["spec", "rating", "voltage"])} then 'datasheet' end as doc_type from asked"""


def c11_field_hints(q: Dialect) -> str:
    """Catalogued fields that a question names: all words of the field stand in it."""
    return f"""with {asked(q)}, f as (select distinct field_name, {q.filter(q.split("field_name", "_"), "w", "w <> ''")} as parts from {q.t("field_catalog")})
    select id, field_name from asked join f on {q.size("parts")} > 0 and {q.size(q.filter("parts", "w", "not contains(lower(question), w)"))} = 0"""


def c42_scale(q: Dialect) -> str:
    """Judge scores from 1 to 5 as numbers from 0 to 1; others clamped first."""
    return f"select event_id, round((greatest(1.0, least(5.0, value)) - 1) / 4 + cast(0.000000001 as double), 4) as scaled from {q.t('events')}"


def h6_weak(q: Dialect) -> str:
    """Whether none of the first three contexts of a prediction names a code of its question: a weak context."""
    return f"""with {_pairs(q)}, m as (select id, model_name, pos, case when {q.size(q.filter("prods", "w", "contains(low, w)"))} > 0 then 1 else 0 end as hit from pairs where {q.size("prods")} > 0)
    select id, model_name, max(hit) = 0 as weak from m where pos < 3 group by id, model_name"""


def r1_templates(q: Dialect) -> str:
    """Templated questions from records: one per product and field."""
    return f"select distinct product_name, field_name, concat('What is the ', replace(field_name, '_', ' '), ' of the ', product_name, '?') as question from {q.t('product_records')} where product_name is not null and field_name in (select field_name from {q.t('field_catalog')})"


def r5_validate(q: Dialect) -> str:
    """Reasons to reject a question: too short, no answer, answer not grounded in the contexts."""
    flag = lambda c, n: f"case when {c} then '{n}' end"
    shared, own = q.size(q.common("ans", "ctx_words")), q.size("ans")
    return f"""with x as (select distinct id, coalesce(question, '') as question, coalesce(ground_truth, '') as truth, {contexts(q, "contexts")} as ctx from {q.t("autoq_questions")}),
    y as (select id, question, truth, {tokens(q, "truth")} as ans, {tokens(q, q.join("ctx", " "))} as ctx_words from x)
    select id, concat_ws(';', {flag("length(question) < 12", "question_short")}, {flag(f"{own} = 0", "no_answer")}, {flag(f"{own} > 0 and 4 * {shared} < {own}", "not_grounded")}) as reasons from y"""


def r9_category(q: Dialect) -> str:
    """Categories in one spelling, counted."""
    return f"select {q.sub('lower(trim(category))', '[^a-z0-9]+', '_')} as category, count(distinct id) as n from {q.t('autoq_questions')} where category is not null group by 1" if not q.spark else f"select category, count(distinct id) as n from (select id, {q.sub('lower(trim(category))', '[^a-z0-9]+', '_')} as category from {q.t('autoq_questions')} where category is not null) x group by category"




def _questions(spark: SparkSession, d: str, every: int = 1) -> DataFrame:
    q = table(spark, d, "autoq_questions").where("id is not null and question is not null")
    if every > 1:
        q = q.where(F.col("id").try_cast("bigint") % every == 0)
    return q.groupBy("id").agg(F.min("question").alias("question"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"with {corpus(SparkDialect(d, spark))} select * from chunks")


def f16_substring(spark: SparkSession, d: str) -> DataFrame:
    """Products whose name stands in a question of the query set, or which hold one of its codes of at least three characters."""
    q = SparkDialect(d, spark)
    asked_ = keep(spark.sql(f"with {asked(q, f'try_cast(id as bigint) % {QUERIES_OF} = 0')} select id, question, prods from asked"))
    names = table(spark, d, "products").select(F.col("product_name").alias("key"), F.col("product_name").alias("name"), F.col("product_name").alias("text")).where(F.length("name") >= 3)
    codes = asked_.select("id", F.explode("prods").alias("code")).where(F.length("code") >= 3)
    named = contained(names, asked_.select(F.col("id").alias("key"), F.col("question").alias("text"))).select(F.col("text_key").alias("id"), F.col("name_key").alias("product_name"))
    held = contained(codes.select(F.col("code").alias("key"), F.col("code").alias("name")).distinct(), names.select("key", "text"))
    coded = held.join(codes, held["name_key"] == codes["code"]).select("id", F.col("text_key").alias("product_name"), (F.col("code") == F.lower("text_key")).alias("exact"))
    return named.withColumn("exact", F.lit(False)).unionByName(coded).groupBy("id", "product_name").agg(F.when(F.max("exact"), "exact").otherwise("part").alias("how"))


def e10_match(spark: SparkSession, d: str) -> DataFrame:
    """Products named in a question, by its codes: the exact name alone if there is one, else all names that hold a code or stand in the question."""
    m = f16_substring(spark, d)
    exact = F.max(F.col("how") == "exact").over(Window.partitionBy("id"))
    return m.withColumn("any_exact", exact).where((F.col("how") == "exact") | ~F.col("any_exact")).select("id", "product_name")


def k5_search(spark: SparkSession, d: str) -> DataFrame:
    """The five sections of the greatest positive lexical score of every question of the query set, over all sections."""
    return search(_questions(spark, d, QUERIES_OF), _chunks(spark, d), 5).select("id", "chunk_id", "lexical", F.col("rank").cast("bigint").alias("k"))


def f14_scores(spark: SparkSession, d: str) -> DataFrame:
    """How many sections of the best hundred score at least half the best, by question: the scoring join behind the search, of all questions with all sections."""
    return near_best(_questions(spark, d), _chunks(spark, d), 100)


def k9_staged(spark: SparkSession, d: str) -> DataFrame:
    """Staged hybrid retrieval for the query set."""
    return staged(_questions(spark, d, QUERIES_OF), _chunks(spark, d))


def k10_records(spark: SparkSession, d: str) -> DataFrame:
    """The five best records for every question of the query set; those of the fields it names come first."""
    catalog = table(spark, d, "field_catalog").select("field_name").distinct()
    return search_records(_questions(spark, d, QUERIES_OF), spread(spark, d, "product_records"), catalog)


def k14_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every predicted context that answer its question, and the best answer line of all its contexts (k15)."""
    q = SparkDialect(d, spark)
    pairs = spark.sql(f"with {_pairs(q)} select id, model_name, question, pos, context from pairs")
    return answer_lines(pairs)


SCANS = [k5_search, f14_scores, k9_staged, k10_records, k14_lines, f16_substring, e10_match]
DUAL = [f for n, f in dict(globals()).items() if n[:1] in "cefhkr" and n[1:2].isdigit() and f not in SCANS]
QUERIES, ORACLES = both({f.__name__: f for f in DUAL})
QUERIES |= {f.__name__: f for f in SCANS}

_D = Dialect()
_SCORED = f"""{corpus(_D)}, s as (select id, chunk_id, cast({lexical(_D, "text", "lower(text)", "header", "block", "doc")} as double) as lexical from asked, chunks),
r as (select *, row_number() over (partition by id order by lexical desc, chunk_id) as k from s where lexical > 0)"""
_ALL = f"""with {asked(_D, f"try_cast(id as bigint) % {QUERIES_OF} = 0")}, {_SCORED}"""
_SUBSTRING = f"""with {asked(_D, f"try_cast(id as bigint) % {QUERIES_OF} = 0")}, p as (select distinct product_name, lower(product_name) as low_p from products where length(product_name) >= 3),
m as (select a.id, p.product_name, case when {_D.size(_D.filter("a.prods", "w", "w = p.low_p"))} > 0 then 'exact' else 'part' end as how from asked a join p on contains(lower(a.question), p.low_p) or {_D.size(_D.filter("a.prods", "w", "length(w) >= 3 and contains(p.low_p, w)"))} > 0)"""
ORACLES |= {
    "f16_substring": f"{_SUBSTRING} select * from m",
    "e10_match": f"{_SUBSTRING}, t as (select *, max(case when how = 'exact' then 1 else 0 end) over (partition by id) as any_exact from m) select id, product_name from t where how = 'exact' or any_exact = 0",
    "k5_search": f"{_ALL} select id, chunk_id, lexical, k from r where k <= 5",
    "f14_scores": f"with {asked(_D)}, {_SCORED}, t as (select *, max(lexical) over (partition by id) as top from r where k <= 100) select id, max(top) as best, cast(count(*) filter (where 2 * lexical >= top) as bigint) as near from t group by id",
}
