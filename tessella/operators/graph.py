"""Iterative graph operators as loops of joins; every round is cut off from the one before by a written table.

Edges are (src, dst). Defined results: self-loops and null ends are left out, repeated edges count once,
an empty edge table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.additive import ranges
from tessella.operators.ordinal import with_position
from tessella.session import cut, keep, small

EDGES = 20_000_000  # edges whose neighbour lists are sent to the tasks; beyond it a search is a loop of joins
RANGE, PACKED, FOUND, ROWS = 4_000_000, 200_000, 1_000_000, 50_000  # last round: edges of a range, rows packed together, neighbours of a step, rows handed on at once
SPAN = 16_384  # nodes whose neighbour lists are packed in one row
GROUP, BITS_MB = 2048, 64  # ids of a task at most, and the size of its table of nodes by ids


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    e = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): the nodes within so many hops of each start (column node) with their least distance. edges are read once a round."""
    edges = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")
    seen = front = cut(starts.select(F.col("node").alias("start"), "node").where("node is not null").distinct().withColumn("hops", F.lit(0)))
    for h in range(1, hops):
        step = small(front).join(both, F.col("node") == both["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(small(seen), ["start", "node"], "left_anti").withColumn("hops", F.lit(h)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    return seen.unionByName(last_round(both, edges.count(), seen, front, hops)) if hops else seen


PACK = pa.schema([("a", pa.int64()), ("name", pa.string())])
FRONT = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def hashes(names: pa.Array) -> np.ndarray:
    return pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False)


def packed(df: DataFrame, kind: str, parts: int) -> DataFrame:
    """(part, kind, data): the rows of df as Arrow streams, PACKED rows at a time, those of edges and seen ones by the range of their node; part is null for rows that every range gets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            name = t["name"].combine_chunks()
            own = [None]
            if kind == "front":
                t = pa.table([t["a"], pa.array(hashes(name).view(np.int64))], schema=FRONT)
            else:
                a = pa.array(hashes(t["src"].combine_chunks()).view(np.int64)) if kind == "edge" else t["a"]
                t = pa.table([a, name], schema=PACK)
            data = [t]
            if kind in ("edge", "seen"):
                part = (hashes(name) % parts).astype(np.int32)
                order = np.argsort(part, kind="stable")
                t, (own, at) = t.take(order), np.unique(part[order], return_index=True)
                data = [t.slice(i, j - i) for i, j in zip(at, [*at[1:], len(t)])]
            streams = []
            for x in data:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, x.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_table(x.combine_chunks())
                streams.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([kind] * len(streams)), pa.array(streams, pa.binary())], ["part", "kind", "data"])

        rows: list[pa.RecordBatch] = []
        for batch in batches:
            rows.append(batch)
            if sum(map(len, rows)) >= PACKED:
                yield out(rows)
                rows = []
        if sum(map(len, rows)):
            yield out(rows)

    return df.mapInArrow(pack, "part int, kind string, data binary")


def last_round(both: DataFrame, edges: int, seen: DataFrame, front: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): the nodes next to those of front and not in seen, by start.

    They are by far the most rows, and none is exchanged: every task owns a range of the nodes by hash, gets the edges that end
    there, the rows of seen there and all of front, and so finds all rows of its nodes, each once."""
    spark = both.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-2 * edges // RANGE))
    numbered = cut(with_position(seen.select("start").distinct(), ["start"], "a"))
    number = lambda df: df.join(small(numbered), "start").select(F.col("a").cast("bigint").alias("a"), F.col("node").alias("name"))
    starts = numbered.select(F.col("a").cast("bigint").alias("a"), F.col("start").alias("name"))
    keys = F.array(*map(F.lit, dealt(spark, parts)))
    some = packed(both.select("src", F.col("dst").alias("name")), "edge", parts).unionByName(packed(number(seen), "seen", parts)).select(F.get(keys, "part").alias("key"), "kind", "data")
    every = packed(number(front), "front", parts).unionByName(packed(starts, "start", parts)).select(F.explode(keys).alias("key"), "kind", "data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {"edge": [], "seen": [], "front": [], "start": []}
        for batch in batches:
            for kind, data in zip(batch["kind"].to_pylist(), batch["data"]):
                held[kind].append(pa.ipc.open_stream(data.as_buffer()).read_all())
        if not held["edge"] or not held["front"]:
            return
        edge, known, near, start = (pa.concat_tables(held.pop(k) or [PACK.empty_table()]) for k in ("edge", "seen", "front", "start"))
        ends = pc.dictionary_encode(edge["name"]).combine_chunks()
        names, codes, src = ends.dictionary, ends.indices.to_numpy(), edge["a"].to_numpy()
        del edge, ends
        if len(np.unique(hashes(names))) < len(names):
            raise ValueError("two nodes have one hash; their results would be mixed")
        order = np.argsort(src)
        src, codes = src[order], codes[order]
        del order
        start_names = start["name"].combine_chunks().take(pa.array(np.argsort(start["a"].to_numpy())))
        own = pc.index_in(known["name"], names)
        known = np.sort((known["a"].to_numpy() * len(names) + own.fill_null(-1).to_numpy())[own.is_valid().to_numpy(zero_copy_only=False)])
        s, (mids, of) = near["a"].to_numpy(), np.unique(near["b"].to_numpy(), return_inverse=True)
        order = np.argsort(s, kind="stable")
        s, of = s[order], of[order].astype(np.int32)
        del order, near
        low, high = np.searchsorted(src, mids, "left"), np.searchsorted(src, mids, "right")
        counts = (high - low)[of]
        del src, high
        total, first = np.cumsum(counts), np.flatnonzero(np.diff(s, prepend=-1))
        at = 0
        while at < len(first):
            i = first[at]
            # The starts that follow, as long as their neighbours are few enough; one at least.
            at = max(at + 1, int(np.searchsorted(total[np.append(first[1:], len(s)) - 1], total[i] - counts[i] + FOUND, "right")))
            j = first[at] if at < len(first) else len(s)
            keys = np.unique(np.repeat(s[i:j], counts[i:j]) * len(names) + codes[ranges(low[of[i:j]], counts[i:j])])
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                keys = keys[known[place] != keys]
            for k in range(0, len(keys), ROWS):
                part = keys[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([start_names.take(pa.array(part // len(names))), names.take(pa.array(part % len(names))), pa.array(np.full(len(part), hops, np.int32))], ["start", "node", "hops"])

    return some.unionByName(every).repartition(parts, "key").select("kind", "data").mapInArrow(search, "start string, node string, hops int")


def packs(pairs: DataFrame) -> DataFrame:
    """(first, degrees, others): the neighbours of SPAN nodes from first on, over the undirected pairs (a, b) of node numbers, as bytes of 32-bit numbers."""
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        first = int(a[0]) // SPAN * SPAN
        return pd.DataFrame({"first": [first], "degrees": [np.bincount(a - first, minlength=SPAN).astype(np.int32).tobytes()], "others": [b[np.argsort(a, kind="stable")].astype(np.int32).tobytes()]})

    return both.groupBy(F.floor(F.col("a") / SPAN)).applyInPandas(pack, "first int, degrees binary, others binary")


class Neighbours:
    """The neighbours of each node by number, in one array, from all packs."""

    def __init__(self, pdf: pd.DataFrame, nodes: int):
        pdf = pdf.sort_values("first")
        read = lambda c: np.frombuffer(b"".join(pdf[c]), np.int32)
        self.ends = np.concatenate([[0], np.cumsum(read("degrees")[:nodes], dtype=np.int64)])
        self.others = read("others")
        self.nodes = nodes

    def spread(self, front: np.ndarray) -> np.ndarray:
        """The rows of bits (a bit an id) of the nodes next to those of front."""
        out = np.zeros_like(front)
        for v in np.flatnonzero(front.any(1)):
            out[self.others[self.ends[v] : self.ends[v + 1]]] |= front[v]
        return out


def ones(bits: np.ndarray) -> np.ndarray:
    """How many rows have each bit."""
    return sum((np.unpackbits(bits[at : at + 8192].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64) for at in range(0, len(bits), 8192)), np.zeros(bits.shape[1] * 64, np.int64))


def dealt(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of so many partitions, which an exchange by it deals to that partition alone."""
    at = spark.range(100 * parts).select(F.col("id").cast("int").alias("k"))
    return [r.k for r in at.groupBy(F.pmod(F.hash("k"), F.lit(parts))).agg(F.min("k").alias("k")).collect()]


def within(edges: DataFrame, starts: DataFrame, goals: DataFrame, hops: int) -> DataFrame:
    """(id, nodes, hops): for every id of starts (id, node) the number of nodes within so many hops of any of its nodes, and the least hops to one of its goals (id, node), null beyond. Ids none of whose starts is in the graph have no row.

    Rows of ids and nodes, most of the graph for each id, are never made: a task searches for a group of ids at once, with a
    bit an id at every node. The tasks get the packed graph by an exchange, a copy each; the driver never holds it."""
    spark = edges.sparkSession
    edges = keep(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    starts = keep(starts.select("id", "node").distinct().join(nodes, "node", "left_semi"))
    if edges.count() > EDGES:
        found = starts.select("id", F.col("node").alias("start")).join(bfs(edges, starts.select("node"), hops), "start").groupBy("id", "node").agg(F.min("hops").alias("hops"))
        hit = found.join(goals.select("id", "node").distinct(), ["id", "node"]).groupBy("id").agg(F.min("hops").cast("bigint").alias("hops"))
        return found.groupBy("id").agg(F.count("*").alias("nodes")).join(hit, "id", "left").select("id", "nodes", "hops")
    numbered = small(cut(with_position(nodes, ["node"], "n")))
    number = lambda df, c, to: df.join(numbered.select(F.col("node").alias(c), F.col("n").cast("int").alias(to)), c)
    graph = packs(number(number(edges, "src", "a"), "dst", "b").select("a", "b"))
    n, groups = numbered.count(), spark.sparkContext.defaultParallelism
    most = max(64, min(GROUP, BITS_MB * 8_000_000 // max(n, 1)))
    keys = F.array(*map(F.lit, dealt(spark, groups)))
    wanted = number(starts, "node", "n").withColumn("goal", F.lit(False)).unionByName(number(goals.select("id", "node").distinct(), "node", "n").withColumn("goal", F.lit(True)))
    grouped = wanted.select("id", "n", "goal", F.get(keys, F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).alias("part")).repartition(groups, "part")
    copies = graph.withColumn("part", F.explode(keys)).repartition(groups, "part")

    def search(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": pd.Series([], dtype=object), "nodes": pd.Series([], dtype="int64"), "hops": pd.Series([], dtype="Int64")})]
        if not len(pdf):
            return out[0]
        every = pdf.loc[~pdf["goal"], "id"].unique()
        near = Neighbours(held, n)
        for at in range(0, len(every), most):
            own = every[at : at + most]
            rows = pdf[pdf["id"].isin(own)]
            place = pd.Index(own).get_indexer(rows["id"])
            word, bit, goal, n_of = place >> 6, np.uint64(1) << (place & 63).astype(np.uint64), rows["goal"].to_numpy(), rows["n"].to_numpy()
            front = np.zeros((near.nodes, -(-len(own) // 64)), np.uint64)
            np.bitwise_or.at(front, (n_of[~goal], word[~goal]), bit[~goal])
            seen, least = front.copy(), np.full(len(own), hops + 1)
            for h in range(hops + 1):
                hit = front[n_of[goal], word[goal]] & bit[goal] > 0
                np.minimum.at(least, place[goal][hit], h)
                if h < hops:
                    front = near.spread(front)
                    front &= ~seen
                    seen |= front
            out.append(pd.DataFrame({"id": own, "nodes": ones(seen)[: len(own)], "hops": pd.array(np.where(least > hops, 0, least), "Int64")}))
            out[-1].loc[least > hops, "hops"] = pd.NA
        return pd.concat(out)

    return grouped.groupBy("part").cogroup(copies.groupBy("part")).applyInPandas(search, "id string, nodes bigint, hops bigint")


def hops_to(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(node, hops): the least distance of every node to any goal (column node), over the undirected edges until nothing new is reached.

    One breadth-first search from all goals at once, so its cost does not grow with the number of starts."""
    both = cut(undirected(edges))
    front = seen = cut(goals.select("node").distinct().withColumn("hops", F.lit(0)))
    h = 0
    while not front.isEmpty():
        h += 1
        step = front.join(both, front["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(h)))
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected components, named by their least node.

    Alternates large-star and small-star steps until nothing changes, so that chains shrink in a logarithmic number of
    rounds; a hub's neighbours are rewritten to its least neighbour and never gathered in one task. A round runs one
    write and one aggregate, which tells by count and hashes whether the links are those of the round before."""
    pairs = cut(edges.select("src", "dst").where("src is not null and dst is not null"))
    loops = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    links = undirected(pairs).where("src > dst")
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        large = cut(large)
        least2 = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least2, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        links = cut(small)
        # Two independent sums of hashes: equal ones of different link sets would need a collision in both.
        sums = [F.sum(F.xxhash64(F.lit(k), "src", "dst").cast("decimal(38,0)")) for k in (1, 2)]
        now = tuple(links.agg(F.count("*"), *sums).first())
        if now == mark:
            break
        mark = now
    return loops.join(links.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def path_precision(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(question, precision): share of the undirected edges found that are among the gold ones."""
    key = lambda d: d.select("question", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    f, g = key(found), key(gold).withColumn("hit", F.lit(1))
    return f.join(g, ["question", "a", "b"], "left").groupBy("question").agg((F.count("hit") / F.count("*")).alias("precision"))
