"""Scalar text functions, chunking and extraction in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.ordinal import with_position
from tessella.plans.dialect import Dialect, both, quote
from tessella.session import table

# Stop words of the token bag and of the overlap set, words of the query terms, headers, repairs and rules.
BAG_STOP = "a an and are as at be by for from in is it of on or the to what which with".split()
QUESTION_TYPES = [
    ("capacity", ["how many", "maximum number", "capacity"]),
    ("enumerated_settings", ["settings", "selectable", "candela"]),
    ("single_numeric_spec", ["rated", "voltage", "temperature", "dimensions", "frequency", "impedance"]),
    ("compatibility", ["compatible", "supports"]),
    ("usage", ["where", "used for", "designed for", "applications"]),
    ("procedure", ["install", "wire", "mount", "setup"]),
]
HEADERS = r"^\s*(installation|specifications?|technical specifications|features|features and benefits|functions|description|general|electrical|mechanical|environmental|ordering information|parameters|input/output|approvals?|maintenance|overview|notes|wiring|questions)\s*$"
ALIASES = {"bacnet protocol": "bacnet", "bacnet/ip": "bacnet", "bacnet ip": "bacnet", "bacnet mstp": "bacnet", "bacnet ms tp": "bacnet", "modbus protocol": "modbus", "24 volts": "24v", "24 volt": "24v", "24 v": "24v", "24vdc": "24v", "24 vac": "24v", "24vac": "24v"}
CUE_PHRASES = ["up to", "rated input voltage", "operating temperature", "voltage", "capacity", "compatible"]
SPEC_CUES = "voltage|power|candela|zones?|inputs?|outputs?|rated|temperature|capacity|impedance|[0-9]"
COMPONENTS = "controller|sensor|module|amplifier|speaker|strobe|microphone|telephone|expander|panel|circuit|loop"


def docs(q: Dialect) -> str:
    return f"(select doc_id, replace(text, '\u00a0', ' ') as text from {q.t('documents')} where text is not null)"


def asked(q: Dialect) -> str:
    return f"(select distinct id, question, ground_truth from {q.t('autoq_questions')} where question is not null)"


def any_of(column: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {quote(t)})" for t in terms) + ")"


def c1_normalise(q: Dialect) -> str:
    return f"select doc_id, trim({q.sub('lower(text)', '[ \\t\\r\\n]+', ' ')}) as plain from {docs(q)} d"


def c2_token_set(q: Dialect) -> str:
    from tessella.plans.evaluate import STOPWORDS

    return f"select doc_id, {q.join(q.sort(q.distinct(q.words('text', STOPWORDS, 2))), ' ')} as tokens from {docs(q)} d"


def c3_token_bag(q: Dialect) -> str:
    return f"select id, {q.join(q.words('question', BAG_STOP, 1), ' ')} as terms from {asked(q)} d"


def c7_numbers(q: Dialect) -> str:
    return f"select id, {q.join(q.sort(q.distinct(q.find('question', '[0-9]+(?:[.][0-9]+)?'))), ' ')} as numbers from {asked(q)} d"


def c8_cues(q: Dialect) -> str:
    """Which cue phrases a question holds."""
    return f"select id, {q.join(q.filter(q.array(*map(quote, CUE_PHRASES)), 'p', 'contains(lower(question), p)'), '|')} as cues from {asked(q)} d"


def c9_question_type(q: Dialect) -> str:
    """The first rule that holds names the type."""
    rules = " ".join(f"when {any_of('lower(question)', terms)} then '{name}'" for name, terms in QUESTION_TYPES)
    return f"select id, case {rules} else 'general' end as question_type from {asked(q)} d"


def c13_char_repair(q: Dialect) -> str:
    """Dashes, quotes and spaces in plain form, blanks before units of one form."""
    return f"select doc_id, {q.sub('translate(text, ' + quote('–—‑−’‘“”  ') + ', ' + quote('----') .rstrip(chr(39)) + chr(39) * 4 + chr(34) * 2 + '  ' + chr(39) + ')', '[ \\t]+', ' ')} as repaired from {docs(q)} d"


def c18_slug(q: Dialect) -> str:
    return f"select product_name, {q.sub(q.sub('lower(product_name)', '[^a-z0-9]+', '_'), '^_+|_+$', '')} as slug from {q.t('products')}"


def c19_doc_type(q: Dialect) -> str:
    return f"select doc_id, case when contains(lower(source_path), 'install') then 'installation' when contains(lower(source_path), 'datasheet') or contains(lower(source_path), 'data_sheet') then 'datasheet' when contains(lower(source_path), 'manual') then 'manual' else 'other' end as inferred from {q.t('source_documents')}"


def c21_noise(q: Dialect) -> str:
    """Chunks without use: table-like, short figures, or short without any specification."""
    n = q.size(q.find("lower(text)", "[^ \\t\\r\\n]+"))
    spec = q.like("lower(text)", SPEC_CUES)
    return f"select doc_id, (contains(lower(text), 'table') or contains(lower(text), 'ul listed') or (contains(lower(text), 'figure') and {n} < 30) or ({n} < 15 and not {spec})) as noise from {docs(q)} d"


def sentences(q: Dialect, text: str) -> str:
    """Sentences by mark and split, which both regular expression dialects know."""
    marked = q.sub(text, "([.!?])[ \\t\\r\\n]+|[\\r\\n]+", "\\1" + chr(1))
    return q.filter(q.map(q.split(marked, chr(1)), "s", "trim(s)"), "s", "s <> ''")


def c22_sentences(q: Dialect) -> str:
    return f"select doc_id, {q.size(sentences(q, 'text'))} as n, {q.join(q.slice(sentences(q, 'text'), '1', '2'), ' | ')} as first_two from {docs(q)} d"


def d9_sentences(q: Dialect) -> str:
    """One row per sentence with its position."""
    return f"select doc_id, {q.positions('s', 'pos', 'sentence')} from (select doc_id, {sentences(q, 'text')} as s from {docs(q)} d) x"


def c24_normalize_entity(q: Dialect) -> str:
    """Field values as entities in canonical form; what is left empty is an empty text."""
    one = entity(q, q.array("field_value"))
    return f"select field_value, {q.join(one, '')} as entity from (select distinct field_value from {q.t('product_records')} where field_value is not null) x"


def c25_ordered_unique(q: Dialect) -> str:
    """The canonical entities of a question's packed products, the first of equal ones kept; sorted for comparison."""
    return f"select distinct id, {q.join(q.sort(q.distinct(entity(q, q.split('source_product', '[|;]')))), '|')} as entities from {q.t('autoq_questions')} where source_product is not null"


def c30_targets(q: Dialect) -> str:
    """Target entities of a question: its product text split at bars, commas, slashes and `and`, and the whole of it."""
    parts = q.cat(q.split("source_product", r"(?i)\||,|/|\band\b"), q.array("source_product"))
    return f"select distinct id, {q.join(q.sort(q.distinct(entity(q, parts))), '|')} as targets from {q.t('autoq_questions')} where source_product is not null"


def c27_answer_norm(q: Dialect) -> str:
    return f"select id, trim({q.sub(q.sub('lower(coalesce(ground_truth, ' + chr(39) * 2 + '))', ' x ', ' by '), '[^a-z0-9]+', ' ')}) as answer from {asked(q)} d"


def c33_local_part(q: Dialect) -> str:
    """The last part of a path."""
    return f"select doc_id, {q.group('source_path', '([^/#:]+)$')} as local_part from {q.t('source_documents')}"


def c34_tokens(q: Dialect) -> str:
    return f"select doc_id, greatest(1, cast(floor(length(text) / 4.0) as bigint)) as est_tokens from {docs(q)} d"


def c38_penalty(q: Dialect) -> str:
    """Index-like texts count a quarter."""
    n = q.size(q.find("substr(text, 1, 1200)", r"\b\d{1,3}\b"))
    return f"select doc_id, case when contains(concat(' ', lower(substr(text, 1, 350)), ' '), ' index ') or {n} >= 35 then 0.25 else 1.0 end as penalty from {docs(q)} d"


def c40_tristate(q: Dialect) -> str:
    return f"select event_id, case when value >= 20 then 'hit' when value <= 5 then 'miss' else 'uncertain' end as state from {q.t('events')}"


def d1_sections(q: Dialect) -> str:
    """Lines under the header before them, numbered by a running count of headers."""
    return f"""with l as (select doc_id, {q.positions("ls", "pos", "line")} from (select doc_id, {q.split("text", chr(10))} as ls from {docs(q)} d) x),
    h as (select doc_id, pos, line, case when {q.like("lower(line)", HEADERS)} then 1 else 0 end as is_header from l),
    s as (select *, sum(is_header) over (partition by doc_id order by pos rows between unbounded preceding and current row) as section from h)
    select doc_id, cast(section as bigint) as section, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars from s group by doc_id, section"""


def windows(q: Dialect, size: int, overlap: int) -> str:
    """Chunks of words: windows of size words that step by size - overlap, until one reaches the end."""
    step = size - overlap
    starts = q.seq("0", f"greatest(0, cast(ceil(({q.size('w')} - {size}) / {step}.0) as bigint)) * {step}", str(step))
    return f"""c as (select doc_id, w, {q.positions(starts, "k", "start")} from (select doc_id, {q.find("text", "[^ \\t\\r\\n]+")} as w from {docs(q)} d) x where {q.size("w")} > 0),
    chunks as (select doc_id, k, concat(cast(doc_id as varchar(20)), '#chunk_', lpad(cast(k as varchar(10)), 4, '0')) as chunk_id, {q.slice("w", "start + 1", str(size))} as words from c)"""


def d4_windows(q: Dialect) -> str:
    """Word-window chunks of 100 with overlap 20."""
    return f"with {windows(q, 100, 20)} select chunk_id, {q.size('words')} as n, {q.join('words', ' ')} as chunk from chunks"


def d8_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 15 in order of id, numbered without one task for all rows."""
    rows = with_position(table(spark, d, "source_documents").select("doc_id"), ["doc_id"])
    return rows.select("doc_id", F.floor(F.col("position") / 15).alias("batch"))


KINDS = ("products", "protocols", "voltages", "components", "error_codes")


def entity(q: Dialect, xs: str) -> str:
    """A list of entities in canonical form: lower case, no punctuation at the ends, no trailing `protocol`, voltages as Nv, aliases; empty ones dropped."""
    plain = q.sub(q.sub(q.sub("lower(x)", "[ \\t\\r\\n]+", " "), "^[^a-z0-9]+|[^a-z0-9]+$", ""), " ?protocol$", "")
    volt = "^([0-9]+(?:[.][0-9]+)?)[ -]*(?:v|volt|volts|vac|vdc)(?: ?(?:ac|dc))?$"
    number = q.sub(q.sub(q.group("t", volt), "([.][0-9]*?)0+$", "\\1"), "[.]$", "")
    alias = " ".join(f"when t = '{k}' then '{v}'" for k, v in ALIASES.items())
    return q.filter(q.map(q.map(xs, "x", plain), "t", f"case when {q.like('t', volt)} then concat({number}, 'v') {alias} else trim({q.sub('t', '[^a-z0-9./#+-]+', ' ')}) end"), "e", "e <> ''")


def extracted(q: Dialect, text: str) -> dict[str, str]:
    """The entities of a text by kind, each once and sorted. Accented letters are word characters, whatever the engine's \\b holds them for."""
    text = q.sub(text, "[À-ÖØ-öø-ſ]", "_")
    found = {
        "products": q.find(text, r"\b[A-Z][A-Z0-9-]{2,}\b"),
        "protocols": q.find(text, r"(?i)\b(?:BACnet|Modbus|LonWorks|SLC|NFC|Wi-?Fi|Ethernet)\b"),
        "voltages": q.find(text, r"(?i)\b\d+(?:\.\d+)?\s*(?:VAC|VDC|volts?|V)\b"),
        "components": q.find(text, rf"(?i)\b(?:{COMPONENTS})\b"),
        "error_codes": q.find(text, r"(?i)\b(?:error|fault|code)\s*[A-Z]?\d{2,5}\b|\bE\d{2,5}\b"),
    }
    return {k: q.sort(q.distinct(entity(q, v))) for k, v in found.items()}


def entities(q: Dialect, text: str) -> str:
    """All entities of a text, each once and sorted."""
    by = list(extracted(q, text).values())
    whole = by[0]
    for x in by[1:]:
        whole = q.cat(whole, x)
    return q.sort(q.distinct(whole))


def e1_entities(q: Dialect) -> str:
    """Entities of every document by kind."""
    return f"select doc_id, {', '.join(f'{q.join(v, chr(124))} as {k}' for k, v in extracted(q, 'text').items())} from {docs(q)} d"


def e2_flatten(q: Dialect) -> str:
    """The entities of all kinds in one list, in the order of the kinds, each once."""
    held = ", ".join(f"{v} as {k}" for k, v in extracted(q, "text").items())
    flat = KINDS[0]
    for k in KINDS[1:]:
        flat = q.cat(flat, q.filter(k, "e", f"not {q.has(flat, 'e')}"))
    return f"select doc_id, {q.join(flat, '|')} as entities from (select doc_id, {held} from {docs(q)} d) x"


def spoken(q: Dialect, sentence: str) -> str:
    """A sentence in the canonical form of its entities, with a blank at either end."""
    t = q.sub(f"translate(lower({sentence}), '‐‑–—', '----')", r"\bbacnet\s*(?:/ip|ip\b|mstp\b|ms/tp|protocol\b)?", " bacnet ")
    t = q.sub(t, r"\b(\d+(?:\.\d+)?)\s*(?:vdc|vac|volts?|v)(?:\s*(?:dc|ac))?\b", " \\1v ")
    return "concat(' ', " + q.sub(q.sub(q.sub(t, "[^a-z0-9./#+-]+", " "), "[./#+-]+( |$)", " "), " +", " ") + ", ' ')"


def c23_sentence(q: Dialect) -> str:
    """Every sentence in the canonical form of its entities."""
    return f"with s as ({d9_sentences(q)}) select doc_id, pos, trim({spoken(q, 'sentence')}) as plain from s"


def present(q: Dialect) -> str:
    """CTE present: the sentences with their document's entities that stand in them as whole tokens, by kind; a sentence meets its own document's list only."""
    held = ", ".join(f"{v} as {k}" for k, v in extracted(q, "text").items())
    inside = ", ".join(f"{q.filter(k, 'e', 'contains(z.plain, concat(chr(32), e, chr(32)))')} as {k}" for k in KINDS)
    # The canonical form is made with the sentence, so that the filters only read it.
    said = q.map(sentences(q, "text"), "x", q.struct(sentence="x", plain=spoken(q, "x")))
    return q.once("present", f"""pd as (select doc_id, {held}, {said} as s from {docs(q)} d), pe as (select doc_id, {', '.join(KINDS)}, {q.positions("s", "pos", "z")} from pd),
    present as (select doc_id, cast(pos as bigint) as pos, z.sentence as sentence, {inside} from pe)""")


def e4_present(q: Dialect) -> str:
    """Entities of the document that stand in each sentence as whole tokens, with their kind."""
    one = lambda k: f"select doc_id, pos, '{k}' as kind, {q.explode(k)} as entity from present"
    return f"with {present(q)} {' union all '.join(one(k) for k in KINDS)}"


def l1_cooc(q: Dialect) -> str:
    """Co-occurrence graph: entities of one document, weighted by documents."""
    return f"""with e as (select doc_id, {q.explode("es")} as entity from (select doc_id, {entities(q, "text")} as es from {docs(q)} d) x)
    select a.entity as src, b.entity as dst, count(*) as weight, min(a.doc_id) as first_doc from e a join e b on a.doc_id = b.doc_id and a.entity < b.entity group by a.entity, b.entity"""


# Cues of the relation rules.
CUES = {
    "supports": r"\b(supports?|supporting|protocol|communicates?|communication|network|networked|ethernet|bacnet|modbus|slc)\b",
    "voltage": r"\b(requires?|powered|power|supply|voltage|operat(?:es|ing)|input|output|vdc|vac|volts?)\b",
    "component": r"\b(includes?|contains?|has|with|features?|equipped|module|sensor|controller|panel|amplifier|speaker|strobe|microphone|circuit|loop)\b",
    "compatible": r"\b(compatible with|works with|used with|connects? to|interfaces? with|integrates? with|supports?)\b",
    "install": r"\b(install(?:ed|ation)?|mount(?:ed|ing)?|wire(?:d|s|ing)?|connect(?:ed|s|ion)?)\b",
    "error": r"\b(error|fault|trouble|indicates?|means|code|condition|alarm)\b",
}


def relations(q: Dialect) -> str:
    """CTE relations: (doc_id, pos, sentence, src, dst, relation, confidence) by the six rules of a sentence."""
    cue = lambda name: q.like("lower(sentence)", CUES[name])
    both = q.distinct(q.cat("products", "components"))
    few = q.slice("components", "1", "8")
    rules = [
        ("supports_protocol", both, "protocols", f"case when {cue('supports')} then 0.92 else 0.78 end", "true"),
        ("requires_voltage", both, "voltages", f"case when {cue('voltage')} then 0.94 else 0.8 end", "true"),
        ("has_component", "products", "components", f"case when {cue('component')} then 0.9 else 0.72 end", "true"),
        ("compatible_with", "products", few, "0.86", cue("compatible")),
        ("installed_with", "products", few, "0.84", cue("install")),
        ("indicates_fault", "error_codes", both, "0.9", cue("error")),
    ]
    one = lambda name, a, b, c, where: f"select doc_id, pos, sentence, src, {q.explode('bs')} as dst, '{name}' as relation, cast(confidence as double) as confidence from (select doc_id, pos, sentence, {q.explode(a)} as src, {b} as bs, {c} as confidence from present where {where}) r"
    return f"{present(q)}, relations as ({' union all '.join(one(*r) for r in rules)})"


def l2_typed(q: Dialect) -> str:
    """Rule-typed edges of sentences, each once: rule firings, documents, greatest confidence, and the first evidence, cut to 240 characters."""
    first = "min_by" if q.spark else "arg_min"
    clean = f"substr(trim({q.sub('sentence', '[ \\t\\r\\n]+', ' ')}), 1, 240)"
    return f"""with {relations(q)} select src, dst, relation, count(*) as weight, count(distinct doc_id) as documents, max(confidence) as confidence, {first}({clean}, doc_id * 100000 + pos) as evidence from relations where src <> dst group by src, dst, relation"""


def l3_kinds(q: Dialect) -> str:
    """The kinds of every entity, joined."""
    one = lambda k: f"select '{k}' as kind, {q.explode(k)} as entity from (select {extracted(q, 'text')[k]} as {k} from {docs(q)} d) x"
    return f"with k as ({' union all '.join(one(k) for k in KINDS)}) select entity, {q.join(q.collect('kind'), '|')} as kinds, count(*) as documents from k group by entity"


def i5_selection(q: Dialect) -> str:
    """The 48 documents with the strongest signal that have at least two entities: 3 for each product, protocol and voltage, 2 for each code, 1 for each component."""
    weights = dict(zip(KINDS, (3, 3, 3, 1, 2)))
    held = ", ".join(f"{v} as {k}" for k, v in extracted(q, "text").items())
    score = " + ".join(f"{w} * {q.size(k)}" for k, w in weights.items())
    return f"select doc_id, {score} as score from (select doc_id, {held} from {docs(q)} d) x where {' + '.join(q.size(k) for k in KINDS)} >= 2 order by score desc, doc_id limit 48"


def k20_best(q: Dialect) -> str:
    """The context that shares most words with the truth, whole; ties to the first."""
    from tessella.plans.evaluate import contexts, tokens

    return f"""with x as (select distinct id, ground_truth, {contexts(q, "contexts")} as ctx from {q.t("autoq_questions")} where ground_truth is not null), e as (select id, ground_truth, {q.positions("ctx", "pos", "c")} from x),
    s as (select id, pos, c, {q.size(q.common(tokens(q, "c"), tokens(q, "ground_truth")))} as shared from e), r as (select *, row_number() over (partition by id order by shared desc, pos) as k from s)
    select id, cast(pos as bigint) as pos, shared, c as best from r where k = 1"""


DUAL = [f for n, f in dict(globals()).items() if n[:1] in "cdeikl" and n[1:2].isdigit() and f is not d8_batches]
QUERIES, ORACLES = both({f.__name__: f for f in DUAL})
QUERIES["d8_batches"] = d8_batches
ORACLES["d8_batches"] = "select doc_id, cast(floor((row_number() over (order by doc_id) - 1) / 15.0) as bigint) as batch from source_documents"
