"""One query text for two SQL dialects: Spark SQL for the engine, DuckDB SQL for the check.

A query is a function of a `Dialect`; whatever both dialects write alike is written plainly, the rest goes
through the dialect's methods.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.session import keep, tasks_missing

TEXTS = ("documents", "autoq_questions", "predictions", "product_records")  # tables whose expressions cost more than their scan


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Dialect:
    """DuckDB's spelling."""

    spark = False
    nl = "chr(10)"
    empty = "cast([] as varchar[])"

    def t(self, name: str) -> str:
        return name

    def once(self, name: str, ctes: str) -> str:
        """CTEs whose last is used several times."""
        return ctes

    def fn(self, var: str, body: str) -> str:
        return f"lambda {var}: {body}"

    def re(self, pattern: str) -> str:
        return quote(pattern)

    def filter(self, a: str, var: str, body: str) -> str:
        return f"list_filter({a}, {self.fn(var, body)})"

    def map(self, a: str, var: str, body: str) -> str:
        return f"list_transform({a}, {self.fn(var, body)})"

    def find(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.re(pattern)})"

    def sub(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, {self.re(pattern)}, {quote(to)}, 'g')"

    def like(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.re(pattern)})"

    def group(self, text: str, pattern: str, n: int = 1) -> str:
        return f"regexp_extract({text}, {self.re(pattern)}, {n})"

    def size(self, a: str) -> str:
        return f"cast(len({a}) as bigint)"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {quote(sep)})"

    def array(self, *xs: str) -> str:
        return f"list_value({', '.join(xs)})"

    def cat(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def struct(self, **xs: str) -> str:
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in xs.items()) + ")"

    def explode(self, a: str) -> str:
        return f"unnest({a})"

    def positions(self, a: str, pos: str, value: str) -> str:
        """Two select items: the index from 0 and the element."""
        return f"unnest(range(len({a}))) as {pos}, unnest({a}) as {value}"

    def split(self, text: str, pattern: str) -> str:
        return f"regexp_split_to_array({text}, {self.re(pattern)})"

    def strings(self, json: str) -> str:
        """The elements of a JSON array as texts (objects as JSON), an empty array if it is none."""
        return f"case when json_valid({json}) and json_type({json}) = 'ARRAY' then list_transform(from_json({json}, '[\"JSON\"]'), lambda e: e ->> '$') else cast([] as varchar[]) end"

    def valid_object(self, *texts: str) -> str:
        """The first of some texts that is a JSON object, null if none is."""
        return "coalesce(" + ", ".join(f"case when json_valid({t}) and json_type({t}) = 'OBJECT' then {t} end" for t in texts) + ")"

    def field(self, json: str, name: str) -> str:
        return f"json_extract_string({json}, '$.{name}')"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"list_slice({a}, cast({start} as bigint), cast({start} + {n} - 1 as bigint))"

    def seq(self, a: str, b: str, step: str = "1") -> str:
        return f"range(cast({a} as bigint), cast({b} as bigint) + 1, cast({step} as bigint))"

    def count_if(self, c: str) -> str:
        return f"cast(count(*) filter (where {c}) as bigint)"

    def collect(self, x: str) -> str:
        """Sorted distinct values of a group."""
        return f"list_sort(list(distinct {x}))"

    def lines(self, pos: str, line: str) -> str:
        """The lines of a group in order of position, joined by line ends."""
        return f"string_agg({line}, chr(10) order by {pos})"

    def hash_int(self, x: str) -> str:
        """A portable number from 0 to 2^32 - 1."""
        return f"cast(('0x' || substr(md5({x}), 1, 8)) as bigint)"

    def day(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%d')"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: cast(p[1] as double) * cast(p[2] as double)))"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def chars(self, x: str) -> str:
        return f"cast(length({x}) as bigint)"

    def words(self, text: str, stop: list[str], least: int) -> str:
        """The words of a text without stop words and shorter ones, with repeats."""
        listed = self.array(*map(quote, stop)) if stop else None
        keep = f"length(w) > {least}" + (f" and not {self.has(listed, 'w')}" if listed else "")
        return self.filter(self.find(f"lower({text})", "[a-z0-9]+"), "w", keep)

    def ratio4(self, num: str, den: str) -> str:
        """num / den in ten-thousandths, rounded half up in whole numbers."""
        return f"cast(floor((2 * 10000 * ({num}) + ({den})) / (2.0 * ({den}))) as bigint)"


class SparkDialect(Dialect):
    spark = True
    empty = "cast(array() as array<string>)"

    def __init__(self, folder: str, spark: SparkSession):
        self.folder, self.session = folder, spark

    def once(self, name: str, ctes: str) -> str:
        """The last of some CTEs computed once when the query runs, so that what follows neither repeats nor inlines its expressions; nothing runs while the text is written."""
        view = f"{name}_{uuid.uuid4().hex}"
        keep(self.session.sql(f"with {ctes} select * from {name}")).createOrReplaceTempView(view)
        return f"{name} as (select * from {view})"

    def t(self, name: str) -> str:
        path = f"{self.folder}/{name}.parquet"
        if name in TEXTS and (n := tasks_missing(self.session, path)):
            return f"(select /*+ REPARTITION({n}) */ * from parquet.`{path}`)"
        return f"parquet.`{path}`"

    def fn(self, var: str, body: str) -> str:
        return f"{var} -> {body}"

    def re(self, pattern: str) -> str:
        return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def filter(self, a: str, var: str, body: str) -> str:
        return f"filter({a}, {self.fn(var, body)})"

    def map(self, a: str, var: str, body: str) -> str:
        return f"transform({a}, {self.fn(var, body)})"

    def find(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.re(pattern)}, 0)"

    def sub(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, {self.re(pattern)}, {quote(to.replace(chr(92), '$'))})"

    def like(self, text: str, pattern: str) -> str:
        return f"({text} rlike {self.re(pattern)})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {quote(sep)})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def cat(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def struct(self, **xs: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in xs.items()) + ")"

    def explode(self, a: str) -> str:
        return f"explode({a})"

    def positions(self, a: str, pos: str, value: str) -> str:
        return f"posexplode({a}) as ({pos}, {value})"

    def split(self, text: str, pattern: str) -> str:
        return f"split({text}, {self.re(pattern)})"

    def strings(self, json: str) -> str:
        return f"case when rtrim({json}) like '%]' and ltrim({json}) like '[%' then coalesce(from_json({json}, 'array<string>', map('allowSingleQuotes', 'false')), cast(array() as array<string>)) else cast(array() as array<string>) end"

    def valid_object(self, *texts: str) -> str:
        return "coalesce(" + ", ".join(f"case when try_variant_get(try_parse_json({t}), '$', 'map<string, variant>') is not null then {t} end" for t in texts) + ")"

    def field(self, json: str, name: str) -> str:
        return f"get_json_object({json}, '$.{name}')"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, cast({start} as int), cast({n} as int))"

    def seq(self, a: str, b: str, step: str = "1") -> str:
        return f"sequence(cast({a} as bigint), cast({b} as bigint), cast({step} as bigint))"

    def count_if(self, c: str) -> str:
        return f"count_if({c})"

    def collect(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def lines(self, pos: str, line: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({pos}, {line}))), x -> x.{line}), '\\n')"

    def hash_int(self, x: str) -> str:
        return f"cast(conv(substr(md5({x}), 1, 8), 16, 10) as bigint)"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, v) -> s + v)"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"


Query = Callable[[Dialect], str]


def spark_query(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    """The query run by Spark over a data directory."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(query(SparkDialect(folder, spark)))

    run.__doc__ = query.__doc__
    return run


def both(named: dict[str, Query]) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """(queries, SQL of the check) of a set of dual queries."""
    return {k: spark_query(q) for k, q in named.items()}, {k: q(Dialect()) for k, q in named.items()}
