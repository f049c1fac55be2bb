"""Near-duplicate records with small edits: all pairs whose word sets are alike to at least a threshold.

Exact set-similarity join by partitioning the universe of words. For a pair of sets that reaches the
Jaccard threshold t, the number of words in only one of them is at most rho * (|r| + |s|) with
rho = (1 - t) / (1 + t).

1. Words are counted in hash buckets. Words of buckets up to a count D are rare. Two alike sets either
   share a rare word, or all their rare words count as differences, which leaves at most
   a(r) + a(s) differences among the frequent words, where a(x) = rho * frequent(x) - (1 - rho) * rare(x)
   is a set's slack.
2. Within a band of sizes the frequent words are hashed into M segments. A set with slack a emits its
   segments in a fixed order until floor(a + A) + 1 of them are not crowded, A being the greatest slack of
   the band. By the pigeonhole principle two alike sets then agree in an emitted segment: of the two, take
   the one whose emission ends first; one of its segments has no difference, and the other set emits it too.
   A set that runs out of segments against partners of a class of slacks, floor(a + the class's bound) + 1
   being more than its calm ones, also emits its crowded segments, marked with both classes. A pair meets in
   them only if both run out against each other, so the many sets of little slack are not compared with
   one another there because a few have much.
3. Allocation is by cost: D and the limit of a crowded segment are the greatest whose comparisons stay
   within a budget for each set. If a band's sets are so small that its segments would hold less than
   MIN_SEGMENT words, it takes half as many segments and adds their one-deletion neighbourhoods, as a
   segment with at most one difference then exists.
4. Sets that share a signature are compared by a parity sketch, which never misses, then verified exactly.

Only bitmaps of at most 2^MAX_BITS bits, and tables by size or count, reach the driver. Equal sets are one
set throughout and are expanded to ids at the end; a crowded signature of two classes is split by the skew join.

Defined results: null texts count as empty; sets without words pair with none; null ids are left out; rows
delivered twice count once; texts are read whole; an empty table gives no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import keep

THRESHOLD = Fraction(7, 10)
MAX_BITS = 27
RARE_BUDGET = 120  # comparisons for each set by rare words
SEGMENT_BUDGET = 800  # comparisons for each set by segments
MIN_SEGMENT = 1.2
BAND = 4  # ratio of the bounds of size bands
SIGNATURES = "sig bigint, key bigint, l int, lo bigint, hi bigint, side int"
CALM, LOWER, UPPER = 0, 1, 2  # side of a signature: it meets all, or as the lower or the upper class of its mark


def word_set(*texts: Column) -> Column:
    """The hashes of the distinct lower-cased words (longest runs of letters and digits) of several texts, sorted."""
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    words = F.filter(F.split(whole, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser; wraps around."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def test_bits(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> np.uint64(6)] >> (buckets & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(buckets: DataFrame, bits: int) -> np.ndarray:
    """The set buckets (column bucket) as a bitmap; at most 2^bits / 64 rows are collected."""
    words = buckets.groupBy(F.shiftright("bucket", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket % 64 as int))")).alias("v")).toPandas()
    out = np.zeros(max(1, (1 << bits) // 64), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return out


def limit_of(counts: DataFrame, sets: int, budget: int) -> int:
    """The greatest count c for which the buckets of at most c rows cost no more than budget comparisons for each set."""
    hist = counts.groupBy("n").agg(F.count("*").alias("m")).orderBy("n").toPandas()
    cost = np.cumsum(hist["n"].to_numpy(float) ** 2 / 2 * hist["m"].to_numpy(float))
    fits = hist["n"].to_numpy()[cost <= budget * sets]
    return int(max(fits[-1] if len(fits) else 2, 2))


@dataclass
class Band:
    """The allocation of one size band."""

    low: int  # frequent words of its sets, from
    high: int  # to below
    slack: float  # greatest slack of the sets that meet in it
    segments: int
    deletions: bool


def bands_of(sizes: list[tuple[int, float, int, float]], rho: float, deletions: bool | None = None) -> list[Band]:
    """Bands from (frequent words, greatest slack, sets, mean slack); bands in which no pair can meet are left out."""
    out = []
    if not sizes:
        return out
    top = max(f for f, *_ in sizes)
    low = 1
    while low <= top:
        high = low * BAND
        own = [s for s in sizes if low <= s[0] < high]
        below = [s for s in sizes if s[0] < low and reach(s[0], s[1], rho) >= low]
        if own and sum(s[2] for s in own + below) > 1:
            slack = max(s[1] for s in own + below)
            if 2 * slack >= 0:
                h = int(2 * slack + 1e-9)
                mean = sum(s[0] * s[2] for s in own) / sum(s[2] for s in own)
                short = mean / (h + 1) < MIN_SEGMENT if deletions is None else deletions
                out.append(Band(low, high, slack, h // 2 + 1 if short else h + 1, short))
        low = high
    return out


def reach(f: int, slack: float, rho: float) -> float:
    """The most frequent words that a set alike to one of f frequent words can have."""
    return (f + max(0.0, slack)) / (1 - rho)


@dataclass
class Sets:
    """A batch of word sets in flat form."""

    key: np.ndarray
    words: np.ndarray
    row: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch, seen: set[int] | None = None) -> Sets:
        """The non-empty sets of a batch (key, words), each key once where seen is given."""
        key = b.column(0).to_numpy(zero_copy_only=False)
        lists = b.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
        size = np.diff(offsets)
        use = size > 0
        if seen is not None:
            fresh = np.zeros(len(key), bool)
            for i, k in enumerate(key.tolist()):
                if k not in seen:
                    seen.add(k)
                    fresh[i] = True
            use &= fresh
        row = np.repeat(np.arange(len(size)), size)
        inside = use[row]
        place = np.cumsum(use) - 1
        return cls(key[use], words[inside], place[row[inside]], size[use])

    def split(self, rare_not: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether each word is frequent, frequent words of each set)."""
        frequent = test_bits(rare_not, self.words & np.uint64(mask))
        return frequent, np.bincount(self.row[frequent], minlength=len(self.size))

    def sketch(self) -> tuple[np.ndarray, np.ndarray]:
        bit = (_mix(self.words, 3) & np.uint64(127)).astype(np.int64)
        starts = np.cumsum(self.size) - self.size
        one = np.uint64(1) << (bit & 63).astype(np.uint64)
        low = np.where(bit < 64, one, np.uint64(0))
        high = np.where(bit >= 64, one, np.uint64(0))
        return np.bitwise_xor.reduceat(low, starts).view(np.int64), np.bitwise_xor.reduceat(high, starts).view(np.int64)


def slack_of(size: np.ndarray, frequent: np.ndarray, rho: float) -> np.ndarray:
    """Slack in steps of a half, rounded up."""
    return np.ceil(2 * (rho * frequent - (1 - rho) * (size - frequent)) - 1e-9) / 2


def segment_signatures(words: np.ndarray, row: np.ndarray, n: int, band: int, segments: int) -> np.ndarray:
    """(n, segments): the signature of each segment, a sum over its words; so a deletion is a difference."""
    at = row * segments + (_mix(words, 11 + band) % np.uint64(segments)).astype(np.int64)
    sums = np.zeros(n * segments, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, at, _mix(words, 5))
    return sums.reshape(n, segments)


def seal(sums: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    """Signatures that differ by band and segment."""
    return _mix(sums ^ _mix(segment.astype(np.uint64) + np.uint64(1000 * (band + 1)), 7), 13)


def crowded_signatures(band: Band, slack: np.ndarray, sig: np.ndarray, calm: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(signature, row, side) of the crowded segments of sets, for each class of partners against which their calm ones do not suffice."""
    own, enough, top = np.ceil(slack - 1e-9).astype(np.int64), calm.sum(1), math.ceil(band.slack)
    for other in range(-top, top + 1):
        most = np.floor(slack + min(other, band.slack) + 1e-9)
        row, segment = np.nonzero(((most >= 0) & (enough < most + 1))[:, None] & ~calm)
        lower, upper = np.minimum(own[row], other), np.maximum(own[row], other)
        mark = ((lower + 1000) * 10_000 + upper + 1000).astype(np.uint64)
        side = np.where(own[row] <= other, LOWER, 0) + np.where(own[row] >= other, UPPER, 0)
        yield _mix(sig[row, segment] ^ _mix(mark, 17), 19), row, side


def meets(band: Band, frequent: np.ndarray, slack: np.ndarray, rho: float) -> np.ndarray:
    """Which sets emit in a band: its own, and smaller ones that may have a partner there."""
    own = (frequent >= band.low) & (frequent < band.high)
    near = (frequent < band.low) & ((frequent + np.maximum(0, slack)) / (1 - rho) >= band.low)
    return (own | near) & (np.floor(slack + band.slack + 1e-9) >= 0)


def candidates(sets: DataFrame, threshold: Fraction = THRESHOLD, deletions: bool | None = None) -> DataFrame:
    """(key_a, key_b) of all pairs of sets (key, words) that may reach the threshold; may hold a pair more than once."""
    spark = sets.sparkSession
    rho = float((1 - threshold) / (1 + threshold))
    n = sets.count()
    bits = min(MAX_BITS, max(12, math.ceil(math.log2(40 * n + 1))))
    mask = (1 << bits) - 1
    # 1. Words by bucket.
    counts = keep(sets.select(F.explode("words").alias("w")).groupBy(F.expr(f"w & {mask}L").alias("bucket")).agg(F.count("*").alias("n")))
    limit = limit_of(counts, n, RARE_BUDGET)
    frequent = spark.sparkContext.broadcast(bitmap_of(counts.where(F.col("n") > limit), bits))
    shared = spark.sparkContext.broadcast(bitmap_of(counts.where(F.col("n") > 1), bits))
    counts.unpersist()

    # 2. Slack by size gives the bands.
    def slacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sets.of(b)
            if not len(s.key):
                continue
            _, f = s.split(frequent.value, mask)
            a = slack_of(s.size, f, rho)
            order = np.lexsort((a, f))
            f, a = f[order], a[order]
            last = np.flatnonzero(np.diff(np.append(f, -1)))
            yield pa.RecordBatch.from_arrays([pa.array(f[last], pa.int64()), pa.array(a[last], pa.float64()), pa.array(np.diff(np.append(-1, last)), pa.int64())], ["f", "a", "n"])

    by_size = sets.select("key", "words").mapInArrow(slacks, "f bigint, a double, n bigint").groupBy("f").agg(F.max("a").alias("a"), F.sum("n").alias("n")).collect()
    bands = bands_of([(r.f, r.a, r.n, r.a) for r in by_size if r.f > 0], rho, deletions)

    # 3. Segments by bucket, to know the crowded and the lonely ones.
    def crowd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            s = Sets.of(b, seen)
            if not len(s.key):
                continue
            is_f, f = s.split(frequent.value, mask)
            a = slack_of(s.size, f, rho)
            for i, band in enumerate(bands):
                use = meets(band, f, a, rho)
                if band.deletions or not use.any():
                    continue
                place = np.cumsum(use) - 1
                w = is_f & use[s.row]
                sums = segment_signatures(s.words[w], place[s.row[w]], int(use.sum()), i, band.segments)
                sig = seal(sums, np.arange(band.segments)[None, :], i).ravel() & np.uint64(mask)
                bucket, m = np.unique(sig, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(m.astype(np.int64))], ["bucket", "n"])

    if any(not b.deletions for b in bands):
        crowds = keep(sets.select("key", "words").mapInArrow(crowd, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")))
        most = limit_of(crowds, n, SEGMENT_BUDGET)
        crowded = spark.sparkContext.broadcast(bitmap_of(crowds.where(F.col("n") > most), bits))
        several = spark.sparkContext.broadcast(bitmap_of(crowds.where(F.col("n") > 1), bits))
        crowds.unpersist()

    # 4. Signatures.
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            s = Sets.of(b, seen)
            if not len(s.key):
                continue
            is_f, f = s.split(frequent.value, mask)
            a = slack_of(s.size, f, rho)
            low, high = s.sketch()
            rare = ~is_f & test_bits(shared.value, s.words & np.uint64(mask))
            sigs, rows = [_mix(s.words[rare], 1)], [s.row[rare]]
            sides = [np.full(len(rows[0]), CALM)]
            for i, band in enumerate(bands):
                use = meets(band, f, a, rho)
                if not use.any():
                    continue
                place, back = np.cumsum(use) - 1, np.flatnonzero(use)
                w = is_f & use[s.row]
                words, row = s.words[w], place[s.row[w]]
                sums = segment_signatures(words, row, len(back), i, band.segments)
                need = np.floor(a[use] + band.slack + 1e-9).astype(np.int64)
                number = np.arange(band.segments)
                sig = seal(sums, number[None, :], i)
                if band.deletions:
                    # Half the segments do, as one with at most one difference exists; a deletion is the sum without the word.
                    on = number[None, :] <= (need // 2)[:, None]
                    seg = (_mix(words, 11 + i) % np.uint64(band.segments)).astype(np.int64)
                    with np.errstate(over="ignore"):
                        less = sums[row, seg] - _mix(words, 5)
                    take = on[row, seg]
                    sigs.append(seal(less[take], seg[take], i))
                    rows.append(back[row[take]])
                    sides.append(np.full(len(rows[-1]) + on.sum(), LOWER + UPPER))
                else:
                    bucket = sig & np.uint64(mask)
                    calm = ~test_bits(crowded.value, bucket)
                    on = calm & (np.cumsum(calm, 1) <= (need + 1)[:, None])
                    on &= test_bits(several.value, bucket)
                    sides.append(np.full(on.sum(), CALM))
                sigs.append(sig[on])
                rows.append(back[np.nonzero(on)[0]])
                if not band.deletions:
                    for marked, r, side in crowded_signatures(band, a[use], sig, calm):
                        sigs.append(marked)
                        rows.append(back[r])
                        sides.append(side)
            sig, row, side = np.concatenate(sigs), np.concatenate(rows), np.concatenate(sides).astype(np.int32)
            for k in range(0, len(sig), 100_000):
                r = row[k : k + 100_000]
                arrays = [sig[k : k + 100_000].view(np.int64), s.key[r], s.size[r].astype(np.int32), low[r], high[r], side[k : k + 100_000]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["sig", "key", "l", "lo", "hi", "side"])

    signs = keep(sets.select("key", "words").mapInArrow(emit, SIGNATURES))
    # 5. Equal signatures. Calm ones are bounded in number, so they are partitioned once and both sides of the
    # join read that; the few crowded ones go through a join of their own, which the skew handling may split.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x, y = F.col("x.key"), F.col("y.key")
    calm_signs = keep(signs.where(F.col("side") == CALM).drop("side").repartition(parts, "sig"))
    lower, upper = [signs.where((F.col("side").bitwiseAND(F.lit(s))) != 0) for s in (LOWER, UPPER)]
    # Within a class both sides hold the same sets, between two classes each pair stands once.
    once = (x < y) | ((F.col("x.side") == LOWER) & (x != y))
    return _meet(calm_signs, calm_signs, x < y, threshold).unionByName(_meet(lower, upper, once, threshold))


def _meet(left: DataFrame, right: DataFrame, once: Column, threshold: Fraction) -> DataFrame:
    """(key_a, key_b) with an equal signature, pruned by size and sketch: |r| + |s| and differences in whole numbers."""
    num, den = threshold.numerator, threshold.denominator
    one, two = left.alias("x"), right.alias("y")
    both = F.col("x.l") + F.col("y.l")
    apart = F.bit_count(F.col("x.lo").bitwiseXOR(F.col("y.lo"))) + F.bit_count(F.col("x.hi").bitwiseXOR(F.col("y.hi")))
    near = once & (apart * (num + den) <= both * (den - num))
    return one.join(two, (F.col("x.sig") == F.col("y.sig")) & near).select(F.least("x.key", "y.key").alias("key_a"), F.greatest("x.key", "y.key").alias("key_b"))


def verified(sets: DataFrame, pairs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(key_a, key_b, similarity) of the candidate pairs that reach the threshold, by their whole sets."""
    spark = sets.sparkSession
    pairs = keep(pairs.distinct())
    bits = min(MAX_BITS, max(12, math.ceil(math.log2(40 * sets.count() + 1))))
    mask = (1 << bits) - 1
    named = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key"))
    wanted = spark.sparkContext.broadcast(bitmap_of(named.select(F.expr(f"key & {mask}L").alias("bucket")), bits))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A filter only: what it lets through in error finds no partner in the join.
        seen: set[int] = set()
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            use = test_bits(wanted.value, key.view(np.uint64) & np.uint64(mask))
            for i in np.flatnonzero(use):
                if (k := int(key[i])) in seen:
                    use[i] = False
                else:
                    seen.add(k)
            yield b.filter(pa.array(use))

    needed = sets.select("key", "words").mapInArrow(take, "key bigint, words array<bigint>").dropDuplicates(["key"])
    a = needed.select(F.col("key").alias("key_a"), F.col("words").alias("words_a"))
    b = needed.select(F.col("key").alias("key_b"), F.col("words").alias("words_b"))
    whole = pairs.join(a, "key_a").join(b, "key_b").withColumn("common", F.size(F.array_intersect("words_a", "words_b")))
    union = F.size("words_a") + F.size("words_b") - F.col("common")
    return whole.where(F.col("common") * threshold.denominator >= union * threshold.numerator).select("key_a", "key_b", (F.col("common") / union).alias("similarity"))


def set_table(questions: DataFrame) -> DataFrame:
    """(id, key, words): equal sets have equal keys."""
    words = questions.where(F.col("id").isNotNull()).select("id", word_set(F.col("question"), F.col("ground_truth")).alias("words"))
    return words.where(F.size("words") > 0).select("id", F.xxhash64("words").alias("key"), "words")


def alike_pairs(questions: DataFrame, threshold: Fraction = THRESHOLD, deletions: bool | None = None) -> DataFrame:
    """(id_a, id_b) of all pairs of different ids whose sets are alike, the smaller id first (as numbers; others after them, as text)."""
    sets = keep(set_table(questions))
    links = verified(sets, candidates(sets, threshold, deletions), threshold)
    members = sets.select("key", "id").distinct()
    # Pairs of different sets, by their members, and pairs within one set.
    across = links.join(members.select(F.col("key").alias("key_a"), F.col("id").alias("i")), "key_a").join(members.select(F.col("key").alias("key_b"), F.col("id").alias("j")), "key_b").select("i", "j")
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    copies = members.join(several, "key")
    within = copies.select("key", F.col("id").alias("i")).join(copies.select("key", F.col("id").alias("j")), "key").where("i < j").select("i", "j")
    number = lambda c: F.col(c).try_cast("decimal(38,0)")
    first = F.when(number("i").isNotNull() & number("j").isNotNull(), number("i") < number("j")).when(number("i").isNotNull() | number("j").isNotNull(), number("i").isNotNull()).otherwise(F.col("i") < F.col("j"))
    pairs = across.unionByName(within).where("i <> j")
    return pairs.select(F.when(first, F.col("i")).otherwise(F.col("j")).alias("id_a"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("id_b")).distinct()
