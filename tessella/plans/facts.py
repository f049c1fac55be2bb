"""Facts of documents: catalogued fields by their labels, lists of locations, primary products; character windows."""

from __future__ import annotations

from tessella.plans.dialect import Dialect, both
from tessella.plans.parsing import lines_of
from tessella.plans.texts import docs


def facts(q: Dialect) -> str:
    """CTE facts: (doc_id, pos, field_name, value, evidence): lines `label: value`, `label | value` or `label value` whose label is a catalogued field; of a document's equal values of a field the first."""
    label = f"trim(lower({q.group('line', '^[ \\t]*([A-Za-z][A-Za-z ]*[A-Za-z])[ \\t]*(?:[:|][ \\t]*|[ ]+)[^ A-Za-z:|][^:]*$')}))"
    value = f"trim({q.group('line', '^[ \\t]*[A-Za-z][A-Za-z ]*[A-Za-z][ \\t]*(?:[:|][ \\t]*|[ ]+)([^ A-Za-z:|][^:]*)$')})"
    value = q.sub(value, "[.]+$", "")
    return f"""{lines_of(q)}, lv as (select doc_id, pos, trim({q.sub("line", "\\r", "")}) as line from l), fl as (select doc_id, cast(pos as bigint) as pos, line, {label} as label, {value} as value from lv),
    fc as (select distinct field_name, replace(field_name, '_', ' ') as label from {q.t("field_catalog")}), fm as (select fl.doc_id, fl.pos, fc.field_name, fl.value, fl.line as evidence from fl join fc on fl.label = fc.label where fl.value <> ''),
    fr as (select *, row_number() over (partition by doc_id, field_name, lower(value) order by pos) as k from fm), facts as (select doc_id, pos, field_name, value, evidence from fr where k = 1)"""


def e7_facts(q: Dialect) -> str:
    """The facts of every document, with their evidence line."""
    return f"with {facts(q)} select * from facts"


def e7_counts(q: Dialect) -> str:
    """How many documents state each field, and how many values it has."""
    return f"with {facts(q)} select field_name, count(distinct doc_id) as documents, count(distinct lower(value)) as distinct_values from facts group by field_name"


def e8_locations(q: Dialect) -> str:
    """Lists of locations: what follows `such as` up to the end of the sentence, split at commas and `and`, if it has at least four members."""
    window = q.group("text", "(?i)such as ([A-Za-z ,-]+)")
    parts = q.distinct(q.filter(q.map(q.split("w", "(?:,|\\band\\b)"), "p", "trim(p)"), "p", "p <> ''"))
    source = f"(select record_id, concat('It suits locations such as ', replace(replace(field_value, '|', ', '), ';', ', '), '.') as text from {q.t('product_records')} where field_name = 'usage_locations' and field_value is not null)"
    return f"with s as (select distinct record_id, text from {source} r), w as (select record_id, {window} as w from s), p as (select record_id, {parts} as parts from w) select record_id, {q.join(q.sort('parts'), '|')} as locations, {q.size('parts')} as n from p where {q.size('parts')} >= 4"


def e9_primary(q: Dialect) -> str:
    """The primary product of a document: the first catalogued name in its text, else its first code, else its own name."""
    code = q.group("text", "(?:^|[^A-Za-z0-9_])([A-Z]{1,5}-[A-Z0-9]{2,})")
    return f"select d.doc_id, coalesce(nullif({code}, ''), m.product_name, concat('document ', cast(d.doc_id as varchar(20)))) as product from {docs(q)} d join (select doc_id, product_name from {q.t('documents')}) m on d.doc_id = m.doc_id"


def d3_chunk_ids(q: Dialect) -> str:
    """Lines of a document as chunks, numbered from 0 after the noise is left out."""
    noise = f"length(trim(line)) < 20 or contains(lower(line), 'table')"  # noqa: F541
    return f"with {lines_of(q)} select concat(cast(doc_id as varchar(20)), '#chunk_', cast(row_number() over (partition by doc_id order by pos) - 1 as varchar(10))) as chunk_id, cast(pos as bigint) as pos from l where not ({noise})"


def d5_characters(q: Dialect) -> str:
    """Windows of 400 characters with overlap 80."""
    starts = q.seq("0", "greatest(0, cast(ceil((n - 400) / 320.0) as bigint)) * 320", "320")
    return f"select doc_id, cast(start as bigint) as start, length(substr(text, cast(start + 1 as int), 400)) as n, substr(text, cast(start + 1 as int), 20) as head from (select doc_id, text, {q.explode(starts)} as start from (select doc_id, text, length(text) as n from {docs(q)} d where length(text) > 0) x) y"


def c36_tokens(q: Dialect) -> str:
    """Tokens of a text by the local substitute of a tokenizer: words, numbers and marks."""
    return f"select doc_id, {q.size(q.find('text', '[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \\t\\r\\n]'))} as tokens from {docs(q)} d"


def a12_html_text(q: Dialect) -> str:
    """The text of web pages: scripts and tags removed, white space collapsed; the pages are made of the documents."""
    page = "concat('<html><head><style>p {x: 1}</style><script>var a = 1;</script></head><body><p class=\"t\">', replace(replace(text, '<', ' '), '>', ' '), '</p><br/></body></html>')"
    bare = q.sub(q.sub(q.sub("page", "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "), "<[^>]+>", " "), "[ \\t\\r\\n]+", " ")
    return f"select doc_id, trim({bare}) as text from (select doc_id, {page} as page from {docs(q)} d) x"


def c43_format(q: Dialect) -> str:
    """Texts escaped for HTML, and shares as per cent."""
    esc = "replace(replace(replace(replace(question, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    return f"select distinct id, {esc} as escaped, concat(cast(cast(floor(length(question) * 1000.0 / 400 + 0.5) as bigint) as varchar(10)), ' per mille') as share from {q.t('autoq_questions')} where question is not null"


DUAL = [f for n, f in dict(globals()).items() if n[:1] in "acde" and n[1:2].isdigit()]
QUERIES, ORACLES = both({f.__name__: f for f in DUAL})
