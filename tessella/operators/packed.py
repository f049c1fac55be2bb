"""Several values packed in one field: one row per value, with its position.

Every text is a lattice: candidate delimiters are its nodes, the texts between two of them its edges.
Expectation-maximisation learns from the whole column how frequent each value is (forward-backward
counts, summed over all rows), and the Viterbi path of the lattice is the split. A value with a
delimiter inside enters the dictionary only if it also stands somewhere as one atom; else every text
seen once would become a value of its own. Quoted spans, spans in
parentheses, fractions before a unit and known names are atomic: no candidate delimiter lies in them.

The dictionary that is broadcast holds the DICTIONARY most frequent values per column and names are
broadcast as a set only if there are at most NAMES of them; the learned weights of rarer values and more
names are joined to the texts that hold them, so both bounds leave the result as it is. Only values that
were not learned get a probability by their length. How many atoms a value may span is learned too: the
atoms of the longest name and of the longest value that stands as one atom (REACH at least), so no known value is
too long to be found.

Defined results: null, empty and blank texts and texts of one value give no row; blank members do not
count; unclosed quotes and brackets are read as plain characters; rows delivered twice count once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.units import field_lookup, squash
from tessella.session import cut, keep, small

DICTIONARY = 50_000
NAMES = 200_000
ROUNDS = 2  # passes of expectation-maximisation
REACH = 4  # atoms that an unlearned value may span; learned ones and names may span as many as they have
SPLIT, JOIN = math.log(0.95), math.log(0.05)
UNKNOWN, PER_CHAR = math.log(0.1), -1.5

_ATOM = re.compile(
    r"""(?P<quoted>"(?:[^"]|"")*"|'(?:[^'])*')(?=\s*(?:$|[|;,/&+\t\n\]}]|and\s|"|'))
      | (?P<round>\([^()]*\))
      | (?P<fraction>(?<!\d)(?<!\d/)\d+/\d+(?=\s*(?:w|watts?)\b))
      | (?P<cut>\s*,\s*and\s+|\s+and\s+|\s*[|;,/&+\t\n]\s*(?:[*•\-–]\s+)?|(?<=\w_)(?!)|\s+)
      | (?P<word>[^\s|;,/&+("']+|.)""",
    re.X | re.I,
)
_BULLET = re.compile(r"^\s*(?:[*•\-–]|\d+[.)])\s+")
_IDENTIFIER = re.compile(r"\w+_\w+$")


def unwrap(text: str) -> str:
    """The text without the marks around a whole list: brackets, braces, and one level of JSON escapes."""
    t = text.strip()
    if t[:1] == '"' and '\\"' in t:
        t = (t[1:-1] if t[-1:] == '"' and len(t) > 1 else t[1:]).replace('\\"', '"').strip()
    if t[:1] in "[{":
        close = "]" if t[0] == "[" else "}"
        t = t[1:-1] if t.endswith(close) else t[1:]
    return _BULLET.sub("", t.strip())


def item(text: str) -> str:
    """A value without outer white space and outer quotes, doubled quotes made single."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        quote, t = t[0], t[1:-1]
        t = t.replace(quote * 2, quote)
    else:
        t = t.replace('""', '"')
    return t.strip()


def lattice(text: str, known: Callable[[str], bool], longest: int | None = None) -> tuple[list[str], list[str]]:
    """(atoms, cuts): cuts[i] is the candidate delimiter between atoms i and i + 1. If `longest` is given, no known name has more atoms."""
    t = unwrap(text)
    atoms, cuts, now, quoted = [], [], "", False
    at = 0
    while at < len(t):
        m = _ATOM.match(t, at)
        kind, piece = m.lastgroup, m.group()
        if kind == "quoted" and now.strip():
            # A quote mark inside a value is a character like any other.
            kind, piece = "word", t[at]
        at += len(piece)
        if kind == "cut" and piece.isspace() and "\n" not in piece and "\t" not in piece:
            before, after = now.strip(), t[at : at + 1]
            following = re.match(r"\w+", t[at:])
            if not (quoted and after in "\"'" and after) and not (_IDENTIFIER.match(before) and following and _IDENTIFIER.match(following.group())):
                now += piece
                continue
        if kind == "cut":
            atoms.append(now)
            cuts.append(piece)
            now, quoted = "", False
        else:
            now += piece
            quoted = kind == "quoted"
    atoms.append(now)
    longest = len(atoms) if longest is None else longest
    if len(atoms) == 1 or longest < 2:
        return atoms, cuts
    # Names hold their delimiters: the longest known span from each atom on becomes one atom.
    out, between, i = [], [], 0
    while i < len(atoms):
        end = i
        for j in range(min(len(atoms), i + longest) - 1, i, -1):
            if known(span(atoms, cuts, i, j)):
                end = j
                break
        out.append(span(atoms, cuts, i, end))
        if end < len(cuts):
            between.append(cuts[end])
        i = end + 1
    return out, between


def span(atoms: list[str], cuts: list[str], i: int, j: int) -> str:
    return (atoms[i] + "".join(cuts[k] + atoms[k + 1] for k in range(i, j))).strip()


_HARD = re.compile(r"[|;\t\n]")
_CUTS = re.compile(r"[|;,/&+\t\n]|\sand\s|\w_\w*\s")


def _edges(atoms: list[str], cuts: list[str], score: Callable[[str], float], reach: int = REACH) -> Iterator[tuple[int, int, str, float]]:
    """The lattice's edges (from, to, value, log weight), at most `reach` atoms long; a value never spans a bar, semicolon, tab or line end."""
    for i in range(len(atoms)):
        for j in range(i, min(len(atoms), i + reach)):
            if j > i and (_HARD.search(cuts[j - 1]) or not atoms[j].strip() or not atoms[i].strip()):
                break
            value = item(span(atoms, cuts, i, j))
            yield i, j + 1, value, (score(value) if value else 0.0) + JOIN * (j - i) + (SPLIT if j < len(cuts) else 0.0)


def scorer(model: dict[str, float], rare: dict[str, float] | None = None) -> Callable[[str], float]:
    """Log weights by the dictionary, by a text's own rare values, else by length."""
    if rare:
        return lambda v: model[v] if v in model else rare[v] if v in rare else UNKNOWN + PER_CHAR * len(v)
    return lambda v: model[v] if v in model else UNKNOWN + PER_CHAR * len(v)


def viterbi(atoms: list[str], cuts: list[str], score: Callable[[str], float], reach: int = REACH) -> list[str]:
    """The values of the best path."""
    best: list[tuple[float, int, str]] = [(0.0, -1, "")] + [(-math.inf, -1, "")] * len(atoms)
    for i, j, value, w in _edges(atoms, cuts, score, reach):
        if best[i][0] + w > best[j][0]:
            best[j] = (best[i][0] + w, i, value)
    out, at = [], len(atoms)
    while at > 0:
        _, at, value = best[at]
        out.append(value)
    return out[::-1]


def expected(atoms: list[str], cuts: list[str], score: Callable[[str], float], add: Callable[[str, bool, float], None], reach: int = REACH) -> None:
    """Forward-backward: adds to each value the probability that it is on the path, apart for one atom and for several joined."""
    if len(atoms) == 1:
        if value := item(atoms[0]):
            add(value, False, 1.0)
        return
    edges = list(_edges(atoms, cuts, score, reach))
    n = len(atoms)
    plus = lambda a, b: b if a == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, _, w in edges:
        ahead[j] = plus(ahead[j], ahead[i] + w)
    for i, j, _, w in reversed(edges):
        back[i] = plus(back[i], back[j] + w)
    for i, j, value, w in edges:
        p = math.exp(min(0.0, ahead[i] + w + back[j] - ahead[n]))
        if value and p > 1e-4:
            add(value, j - i > 1, p)


@dataclass
class Names:
    """The names that hold delimiters: broadcast as a set, or joined to the texts; and the atoms of the longest."""

    held: Broadcast | None
    longest: int

    def of(self, row_names) -> Callable[[str], bool]:
        return self.held.value.__contains__ if self.held is not None else frozenset(row_names if row_names is not None else ()).__contains__


@dataclass
class Model:
    """What was learned: per field the log weights of the most frequent values (broadcast) and how many atoms a value may span; rarer values as a table (field, value, weight), null if there are none."""

    held: Broadcast | None
    reach: dict[str, int]
    full: frozenset[str]
    rare: DataFrame | None


def packed_texts(questions: DataFrame, records: DataFrame, catalog: DataFrame) -> DataFrame:
    """(field, row_key, text) of all fields that may hold several values."""
    lists = small(field_lookup(catalog, ("list",)).select("key"))
    asked = questions.select("id", F.explode(F.create_map(F.lit("source_product"), "source_product", F.lit("source_fields"), "source_fields")).alias("field", "text")).select("field", F.col("id").alias("row_key"), "text")
    valued = records.select("record_id", squash(F.col("field_name")).alias("key"), F.col("field_value").alias("text")).join(lists, "key").select(F.lit("field_value").alias("field"), F.col("record_id").alias("row_key"), "text")
    return asked.unionByName(valued).where(F.col("text").isNotNull() & (F.trim("text") != "") & F.col("row_key").isNotNull())


def _plain(_: str) -> bool:
    return False


def _atoms(text: str) -> int:
    return len(lattice(text, _plain, 0)[0])


def _with_names(texts: DataFrame, products: DataFrame) -> tuple[DataFrame, Names]:
    """The texts, with their own names found by a join if there are more than NAMES names, and the names."""
    names = products.select(F.trim("product_name").alias("name")).where(F.col("name").rlike(r"[,/&+|;\s]")).distinct()

    def longest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [max([_atoms(x) for b in batches for x in b["name"]], default=0)]})

    if names.limit(NAMES + 1).count() <= NAMES:
        held = frozenset(r.name for r in names.collect())
        return texts.withColumn("names", F.lit(None).cast("array<string>")), Names(texts.sparkSession.sparkContext.broadcast(held), max(map(_atoms, held), default=0))
    most = names.mapInPandas(longest, "n bigint").agg(F.max("n").alias("n")).first().n or 0

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for f, k, t in zip(b["field"], b["row_key"], b["text"]):
                atoms, cuts = lattice(t, _plain, 0)
                rows |= {(f, k, span(atoms, cuts, i, j)) for i in range(len(atoms)) for j in range(i + 1, min(len(atoms), i + most))}
            yield pd.DataFrame(list(rows), columns=["field", "row_key", "name"])

    own = texts.mapInPandas(spans, "field string, row_key string, name string").join(names, "name", "left_semi").groupBy("field", "row_key").agg(F.collect_set("name").alias("names"))
    return texts.join(own, ["field", "row_key"], "left"), Names(None, most)


def _with_rare(texts: DataFrame, names: Names, model: Model) -> DataFrame:
    """The texts with the learned weights of their own lattice's values that the dictionary does not hold (two arrays, null where there are none)."""
    if model.rare is None:
        return texts.withColumns({"rare": F.lit(None).cast("array<string>"), "weights": F.lit(None).cast("array<double>")})
    held, reach, full = model.held, model.reach, model.full

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for f, k, t, own in zip(b["field"], b["row_key"], b["text"], b["names"]):
                if f in full:
                    atoms, cuts = lattice(t, names.of(own), names.longest)
                    if len(atoms) > 1:
                        rows |= {(f, k, v) for _, _, v, _ in _edges(atoms, cuts, lambda _: 0.0, reach.get(f, REACH)) if v and v not in held.value[f]}
            yield pd.DataFrame(list(rows), columns=["field", "row_key", "value"])

    found = texts.mapInPandas(values, "field string, row_key string, value string").distinct().join(model.rare, ["field", "value"])
    own = found.groupBy("field", "row_key").agg(F.collect_list(F.struct("value", "weight")).alias("w")).select("field", "row_key", F.col("w.value").alias("rare"), F.col("w.weight").alias("weights"))
    return texts.join(own, ["field", "row_key"], "left")


def _scorer(model: Model, field: str, rare, weights) -> Callable[[str], float]:
    return scorer(model.held.value.get(field, {}) if model.held is not None else {}, dict(zip(rare, weights)) if rare is not None else None)


def learn(texts: DataFrame, names: Names, rounds: int = ROUNDS) -> Model:
    """Log probabilities of the values of every field, by EM over every row."""
    model = Model(None, {}, frozenset(), None)
    for _ in range(rounds):
        light = Model(model.held, model.reach, model.full, None)

        def count(batches: Iterator[pd.DataFrame], model=light) -> Iterator[pd.DataFrame]:
            total: dict[tuple[str, str, bool], float] = defaultdict(float)
            table = lambda: pd.DataFrame([(*k, n, 0 if k[2] or not _CUTS.search(k[1]) else _atoms(k[1])) for k, n in total.items()], columns=["field", "value", "joined", "n", "atoms"])
            for b in batches:
                for f, t, own, r, w in zip(b["field"], b["text"], b["names"], b["rare"], b["weights"]):
                    atoms, cuts = lattice(t, names.of(own), names.longest)
                    expected(atoms, cuts, _scorer(model, f, r, w), lambda v, joined, p, f=f: total.__setitem__((f, v, joined), total[f, v, joined] + p), model.reach.get(f, REACH))
                if len(total) > 200_000:
                    yield table()
                    total.clear()
            yield table()

        weighted = _with_rare(texts, names, model)
        counts = weighted.mapInPandas(count, "field string, value string, joined boolean, n double, atoms int").groupBy("field", "value").agg(F.sum("n").alias("n"), F.bool_and("joined").alias("joined"), F.max("atoms").alias("atoms"))
        counts = keep(counts.where(~F.col("joined")))
        seen = {r.field: r for r in counts.groupBy("field").agg(F.sum("n").alias("s"), F.count("*").alias("values"), F.max("atoms").alias("atoms")).collect()}
        words: dict[str, dict[str, float]] = {f: {} for f in seen}
        for f in sorted(seen):
            for r in counts.where(F.col("field") == f).orderBy(F.desc("n"), "value").limit(DICTIONARY).collect():
                words[f][r.value] = math.log(r.n / seen[f].s)
        more = [f for f in sorted(seen) if seen[f]["values"] > DICTIONARY]
        rare = None
        if more:
            sums = F.create_map(*[F.lit(x) for f in more for x in (f, seen[f].s)])
            rare = cut(counts.where(F.col("field").isin(more)).select("field", "value", F.log(F.col("n") / F.try_element_at(sums, F.col("field"))).alias("weight")))
        counts.unpersist()
        model = Model(texts.sparkSession.sparkContext.broadcast(words), {f: max(REACH, r.atoms) for f, r in seen.items()}, frozenset(more), rare)
    return model


def split_packed(texts: DataFrame, products: DataFrame) -> DataFrame:
    """(field, row_key, pos, item): the values of every text that holds at least two."""
    texts = keep(texts.distinct())
    named, names = _with_names(texts, products)
    model = learn(named, names)
    light = Model(model.held, model.reach, model.full, None)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, k, t, own, r, w in zip(b["field"], b["row_key"], b["text"], b["names"], b["rare"], b["weights"]):
                atoms, cuts = lattice(t, names.of(own), names.longest)
                if len(atoms) > 1:
                    values = [v for v in viterbi(atoms, cuts, _scorer(light, f, r, w), light.reach.get(f, REACH)) if v]
                    if len(values) > 1:
                        rows += [(f, k, i, v) for i, v in enumerate(values, 1)]
            yield pd.DataFrame(rows, columns=["field", "row_key", "pos", "item"])

    return _with_rare(named, names, model).mapInPandas(split, "field string, row_key string, pos bigint, item string").distinct()
