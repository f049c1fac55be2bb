"""Ontologies as tables of triples: a reader of the common part of Turtle, merging, statistics, patterns, class properties.

Read: prefixes, comments, IRIs, prefixed names, `a`, literals with language or type, `;` and `,`. Defined results: a text that
does not parse gives its error and no triple; merging skips such texts and keeps every triple once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(r"""\s*(?:\#[^\n]*\n)?\s*(<[^>\s]*>|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^(?:<[^>]*>|[\w-]*:[\w-]*))?|@prefix|[\w-]*:[\w.-]*[\w-]|[\w-]*:|a(?=\s)|[-+]?\d+(?:\.\d+)?|true|false|[;,.])""")


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    """(subject, predicate, object) of a Turtle text; a ValueError tells where it does not parse."""
    tokens, at = [], 0
    text = re.sub(r"(?m)^\s*#.*$", "", text).strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    prefixes: dict[str, str] = {}

    def full(t: str) -> str:
        if t == "a":
            return TYPE
        if t[0] == "<":
            return t[1:-1]
        if t[0] == '"':
            return re.sub(r'^"((?:[^"\\]|\\.)*)".*$', r"\1", t, flags=re.S)
        if ":" in t:
            p, name = t.split(":", 1)
            if p not in prefixes:
                raise ValueError(f"unknown prefix {p!r}")
            return prefixes[p] + name
        return t

    out, i = [], 0
    while i < len(tokens):
        if tokens[i] == "@prefix":
            if i + 3 >= len(tokens) or tokens[i + 3] != ".":
                raise ValueError("unfinished prefix")
            prefixes[tokens[i + 1].rstrip(":")] = tokens[i + 2][1:-1]
            i += 4
            continue
        subject, predicate = full(tokens[i]), None
        i += 1
        while True:
            if i + 1 >= len(tokens):
                raise ValueError("unfinished statement")
            if predicate is None:
                predicate = full(tokens[i])
                i += 1
            out.append((subject, predicate, full(tokens[i])))
            mark = tokens[i + 1] if i + 1 < len(tokens) else ""
            i += 2
            if mark == ".":
                break
            if mark == ";":
                predicate = None
                if i < len(tokens) and tokens[i] == ".":
                    i += 1
                    break
            elif mark != ",":
                raise ValueError(f"unexpected {mark!r}")
    return out


def check_turtle(text: str) -> tuple[bool, str]:
    """(whether it parses, the error or an empty text)."""
    try:
        parse_turtle(text)
    except (ValueError, IndexError) as e:
        return False, str(e)
    return True, ""


def merged(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(s, p, o) of several ontologies, each triple once; texts that do not parse are skipped."""
    rows = [t for x in texts if check_turtle(x)[0] for t in parse_turtle(x)]
    return spark.createDataFrame(rows, "s string, p string, o string").distinct()


def local(iri: Column) -> Column:
    """The last part of an IRI: behind the last hash, else slash, else colon."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).when(iri.contains("/"), F.substring_index(iri, "/", -1)).otherwise(F.substring_index(iri, ":", -1))


def stats(triples: DataFrame) -> DataFrame:
    """(type, n, names) of everything that has a type."""
    typed = triples.where(F.col("p") == TYPE)
    return typed.groupBy(local(F.col("o")).alias("type")).agg(F.count_distinct("s").alias("n"), F.array_join(F.array_sort(F.collect_set(local(F.col("s")))), "|").alias("names"))


def patterns(triples: DataFrame) -> DataFrame:
    """(domain, property, range): for each object property every domain with every range."""
    of = lambda name, to: triples.where(local(F.col("p")) == name).select("s", local(F.col("o")).alias(to))
    own = triples.where((F.col("p") == TYPE) & (local(F.col("o")) == "ObjectProperty")).select("s")
    return own.join(of("domain", "domain"), "s").join(of("range", "range"), "s").select("domain", local(F.col("s")).alias("property"), "range").distinct()


def class_properties(triples: DataFrame) -> DataFrame:
    """(class, properties): the data properties by their domain, `hasName` as `name`; a class without any has `name`."""
    kind = lambda k: triples.where((F.col("p") == TYPE) & (local(F.col("o")) == k)).select("s")
    data = kind("DatatypeProperty").join(triples.where(local(F.col("p")) == "domain").select("s", F.col("o").alias("c")), "s")
    named = data.select("c", F.when(local(F.col("s")) == "hasName", "name").otherwise(local(F.col("s"))).alias("name"))
    grouped = named.groupBy("c").agg(F.array_sort(F.collect_set("name")).alias("properties"))
    classes = kind("Class")
    return classes.join(grouped, classes["s"] == grouped["c"], "left").select(local(classes["s"]).alias("class"), F.coalesce("properties", F.array(F.lit("name"))).alias("properties"))
