"""Mixing sources to target weights.

Documents are counted by membership pattern (the set of sources a document belongs to). A min-cost flow
routes the patterns' tokens to the sources' quotas: a pattern's first use is free and every repetition
costs more than the one before, so nothing is repeated while fresh text is left. The quotas are the
largest that keep every source with documents at its target. Seeded documents then fill the routed
amounts: whole passes over a pattern, and for the rest the documents with the smallest seeded hashes.

Only the pattern table and a histogram of fixed size reach the driver; a source that holds a third of
all rows is never put in one task.

Defined results: sources without documents or with share 0 get nothing and are reported with share 0;
documents of other sources, of no source and of no tokens are left out; spellings of a source that
differ in case, blanks and punctuation are one source; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.tokens import BYTE_BPE, TOKENIZERS, token_counts
from tessella.session import cut, small

BUCKETS = 1 << 14  # of the seeded hash; a boundary bucket holds about a pattern's rows / BUCKETS


def membership(source: Column) -> Column:
    """The sorted distinct sources named in a source text; several stand between bars or semicolons."""
    keys = F.transform(F.split(source, r"\s*[|;]\s*"), lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


@dataclass
class Arc:
    to: int
    room: float
    cost: float
    back: int


class Flow:
    """Successive shortest paths on a small graph."""

    def __init__(self, n: int):
        self.out: list[list[Arc]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, room: float, cost: float) -> Arc:
        arc = Arc(b, room, cost, len(self.out[b]))
        self.out[a].append(arc)
        self.out[b].append(Arc(a, 0.0, -cost, len(self.out[a]) - 1))
        return arc

    def run(self, s: int, t: int, least: float = 1e-6) -> float:
        total = 0.0
        while True:
            dist, via = [math.inf] * len(self.out), [None] * len(self.out)
            dist[s] = 0.0
            queue = [s]
            for a in queue:
                for k, arc in enumerate(self.out[a]):
                    if arc.room > least and dist[a] + arc.cost < dist[arc.to] - 1e-12:
                        dist[arc.to], via[arc.to] = dist[a] + arc.cost, (a, k)
                        queue.append(arc.to)
            if dist[t] == math.inf:
                return total
            push, at = math.inf, t
            while at != s:
                a, k = via[at]
                push, at = min(push, self.out[a][k].room), a
            at = t
            while at != s:
                a, k = via[at]
                arc = self.out[a][k]
                arc.room -= push
                self.out[at][arc.back].room += push
                at = a
            total += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[float, dict[tuple[tuple[str, ...], str], float]]:
    """(total tokens, tokens of each pattern for each source).

    patterns: tokens per pattern. targets: share and greatest number of uses per source."""
    live = {s: v for s, v in targets.items() if v[0] > 0 and v[1] > 0 and any(s in p and n > 0 for p, n in patterns.items())}
    names, sets = sorted(live), sorted(p for p in patterns if patterns[p] > 0 and set(p) & set(live))
    if not names:
        return 0.0, {}
    share = sum(live[s][0] for s in names)

    def solve(size: float) -> tuple[bool, dict]:
        g = Flow(2 + len(sets) + len(names))
        arcs = {}
        for i, p in enumerate(sets):
            for r in range(max(live[s][1] for s in p if s in live)):
                g.add(0, 2 + i, float(patterns[p]), float(r * r))
            for s in p:
                if s in live:
                    j = 2 + len(sets) + names.index(s)
                    arcs[p, s] = (g.add(2 + i, j, float(patterns[p]) * live[s][1], 0.0), float(patterns[p]) * live[s][1])
        for j, s in enumerate(names):
            g.add(2 + len(sets) + j, 1, size * live[s][0] / share, 0.0)
        return g.run(0, 1) >= size * (1 - 1e-9) - 1e-3, {k: room - a.room for k, (a, room) in arcs.items()}

    most = min(sum(n * live[s][1] for p, n in patterns.items() if s in p) * share / live[s][0] for s in names)
    low, high = 0.0, float(most)
    fits, flows = solve(high)
    if fits:
        low = high
    for _ in range(0 if fits else 50):
        mid = (low + high) / 2
        ok, f = solve(mid)
        low, high, flows = (mid, high, f) if ok else (low, mid, flows)
    if total is not None and total < low:
        low = float(total)
        flows = solve(low)[1]
    return low, flows


def plan(patterns: dict[tuple[str, ...], int], flows: dict[tuple[tuple[str, ...], str], float]) -> list[tuple[str, str, int, float, float, float]]:
    """(pattern, source, whole passes, start, stop, stop2): all documents of a pattern so often, and once more those in the token windows [start, stop) and [0, stop2).

    The sources of one pattern get windows behind one another, so that the uses of a document spread evenly."""
    rows = []
    for p in sorted({p for p, _ in flows}):
        at, size = 0.0, float(patterns[p])
        for s in p:
            amount = flows.get((p, s), 0.0)
            if amount <= 0:
                continue
            whole = int(amount / size + 1e-9)
            stop = at + max(0.0, amount - whole * size)
            rows.append(("|".join(p), s, whole, at, min(stop, size), max(0.0, stop - size)))
            at = stop % size
    return rows


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, name: str = BYTE_BPE, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(uses, report): uses has (doc_id, source, repeats, n_tokens) of every document in the mix; report has each source's target and actual share, the share its target has among the sources with documents, and the deviation from it."""
    spark = docs.sparkSession
    said = {r.source: (float(r.target_share or 0.0), int(r.max_repeats or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r.source is not None}
    # Patterns are sets of target sources only, so that their number does not grow with the sources of the documents.
    wanted = F.array(*[F.lit(s) for s in sorted(said)]).cast("array<string>")
    named = docs.withColumn("pattern", F.array_join(F.array_intersect(membership(F.col("source")), wanted), "|")).where(F.col("pattern") != "")
    sized = token_counts(named, name, folder, carry=("pattern",)).where(F.col("n_tokens") > 0)
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    # Written once: the token counts are the expensive part and are used by every later step.
    sized = cut(sized.select("doc_id", "pattern", "n_tokens", u.alias("u"), F.shiftright(u, 26).cast("int").alias("bucket")))
    tokens = {tuple(r.pattern.split("|")): int(r.n) for r in sized.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()}
    size, flows = route(tokens, said, total)
    steps = spark.createDataFrame(plan(tokens, flows), "pattern string, source string, whole int, start double, stop double, stop2 double")
    # Tokens before each bucket of each pattern: patterns x BUCKETS rows at most.
    hist = sized.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
    ahead = hist.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first, last = F.col("before"), F.col("before") + F.col("n")
    marked = ahead.join(small(steps), "pattern").withColumns(
        {"inside": ((first >= F.col("start")) & (last <= F.col("stop"))) | (last <= F.col("stop2")), "outside": ((last <= F.col("start")) | (first >= F.col("stop"))) & (first >= F.col("stop2"))}
    )
    rows = sized.join(marked.drop("n"), ["pattern", "bucket"])
    edge = ~F.col("inside") & ~F.col("outside")
    # Only boundary buckets need the order of single documents.
    order = Window.partitionBy("pattern", "bucket", "source").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    exact = rows.where(edge).withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    exact = exact.withColumn("part", (((F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))) | (F.col("at") < F.col("stop2"))).cast("int"))
    plain = rows.where(~edge).withColumn("part", F.col("inside").cast("int"))
    cols = ["doc_id", "source", (F.col("whole") + F.col("part")).alias("repeats"), "n_tokens"]
    uses = plain.select(*cols).unionByName(exact.select(*cols)).where("repeats > 0")
    got = uses.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    full = targets.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    # The share that can be reached: that of the target among the sources with documents.
    live = (F.col("tokens") > 0).cast("double") * F.coalesce("target_share", F.lit(0.0))
    every, live_share = full.agg(F.sum("tokens")).scalar(), full.agg(F.sum(live)).scalar()
    report = full.select(
        "source",
        "target_share",
        "max_repeats",
        "documents",
        F.col("tokens").cast("bigint").alias("tokens"),
        F.col("most_repeats").cast("bigint").alias("most_repeats"),
        F.round(F.try_divide(F.col("tokens").cast("double"), every), 6).alias("actual_share"),
        F.round(F.try_divide(live, live_share), 6).alias("reachable_share"),
    )
    return uses, report.withColumn("deviation", F.round(F.col("actual_share") - F.col("reachable_share"), 6))
