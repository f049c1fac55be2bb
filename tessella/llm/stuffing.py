"""Pages of repeated keywords, link lists and product tags instead of sentences.

Every text becomes a sequence of symbols, one character each: function words by their class, content
words by how many stand in a row and whether the word stood just before, numbers, measured values, codes,
links, tags and punctuation. The sequence is cut into segments (a sentence, a line, a link) and long segments
into windows, so that every window is judged against many others of its length.

There are two line types, each with a trigram model of its own: prose, trained on windows of sentences with
function words, and records, trained on lines that end in a measured value. A window with a value to at most
RECORD words is scored as a record, any other as prose. It is abnormal if its perplexity lies outside the
range of the training windows of its type and length, on either side. A page is flagged if more than half of
its characters lie in abnormal windows, or if its own perplexity is abnormally low: a segment that repeats an
earlier one of the page costs only the bits that name it, and a page that has more than SAME of its characters
in such segments of prose says nothing but the same.

The models have at most |SYMBOLS|^3 entries each and the ranges are read from a histogram of fixed size;
both are counted over all documents.

Defined results: null, empty and blank texts are not flagged and have no row; other texts are read whole, at any
length; repeated rows are judged each by itself; extra columns are ignored; without any training window
nothing is abnormal.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import keep

# Function words of English, German, French and Spanish by class; a word in two classes keeps the first.
FUNCTION_WORDS = {
    "d": "the a an this that these those each every any some all both another such no der die das den dem des ein eine einen einem einer eines alle jeder jede jeden le la les l un une des ce cet cette ces tout toute toutes tous chaque el los las una unos unas este esta estos cada todo toda todos todas otro otra",
    "p": "of to in on at by for from with without into onto over under above below near behind between after before since until against along across through during per up down out off about zu zum zur im ins am an auf aus bei beim mit nach von vom vor für über unter hinter neben zwischen durch gegen ohne um bis seit du de dans par pour en au aux à chez entre après avant sous sur sans derrière près depuis vers del al con sin por para sobre bajo tras hasta desde hacia detrás junto",
    "c": "and or but nor so if when while because as than then where how und oder aber nicht wenn als wie weil dass sofern bevor et ou mais car si quand comme donc y o u e pero ni como porque pues cuando donde aunque",
    "n": "it its you your we our us they their them he his him she her i my who which what there here nobody anybody es er sie ich wir ihr ihre ihren sein seine seinen man sich mich il elle on nous vous ils elles se son sa ses leur leurs qui que quoi dont où s y lo me te nos su sus quien cual ellos ella usted",
    "v": "is are was were be been being has have had do does did may might must can could will would should shall ist sind war waren wird werden wurde wurden hat haben hatte muss musste mussten darf dürfen kann können soll sollte est sont était ont été être avoir peut faut doit es son era fue han ha hay hubo ser estar está están debe puede",
    "b": "not only also once never always even just still again both either more most other same no nur auch noch nie erst schon sehr ne pas plus n même encore très más menos muy ya solo sólo antes después también",
}
UNIT_WORDS = "v vac vdc vrms mv kv volt volts a ma ua µa amp amps ampere amperes milliamps w kw mw watt watts ohm ohms kohm ω kω g kg gram grams oz lb lbs m km mm cm ft in yd meter meters metres millimeters hz khz hertz pa kpa hpa mbar psi pascals db s ms sec msec min seconds milliseconds minutes hours h ah mah deg degree degrees rad c f k l/s cfm m3 m³ cu pcs pc % ncm nm stunden sekunden minuten heures secondes minutes horas segundos minutos"
SYMBOLS = {s: s for s in "dpcnvb"} | {"url": "U", "hash": "H", "num": "N", "value": "V", "code": "K", "run1": "1", "run2": "2", "run3": "3", "run4": "4", "run5": "5", "again": "R", "stop": ".", "comma": ",", "colon": ":", "bracket": "(", "bar": "|", "other": "'"}
MEMORY = 24  # content words that a repetition is looked for in, across the segments of a page
WINDOW = 30  # symbols of a window, about; a segment up to a third longer stays whole
LENGTHS = [3, 5, 8, 12, 20]  # upper bounds of the length classes of windows
TAIL = 0.005  # share of the training windows of a type and length on either side of the range
ENOUGH = 100  # training windows from which a length class has a range of its own
SENTENCE = 6  # symbols of a sentence at least; a shorter one goes on in the next
PROSE = 0.25  # share of function words among the words of a training sentence
SPOKEN = 0.6  # share of words among its symbols
RECORD = 8  # words to each measured value of a record at most
SAME = 0.75  # share of its characters in repeated segments, whose perplexity is next to none, from which a page is abnormal
LEAST = 40  # symbols of such a page at least

_UNIT = "|".join(re.escape(u) for u in sorted(UNIT_WORDS.split(), key=lambda u: (-len(u), u)))
_LINK = re.compile(r"""(?i:(?:https?://|www\.)[^\s<>"')\]]+|\b[a-z0-9-]++(?:\.[a-z0-9-]+)*\.[a-z]{2,}/[^\s<>"')\]]*)|\b(?:[a-z0-9][a-z0-9-]++\.)+[a-z]{2,}\b""")
_DOTTED = re.compile(r"[A-Za-z0-9]\.[A-Za-z]|://")
_TOKEN = re.compile(
    rf"""([^\W\d_]++(?:-[^\W\d_]++)*+(?!\w|-\w*\d))[ ]?
      | (\d++(?:[.,:/-]\d+)*+[ \xa0]?(?i:(?:{_UNIT})(?:[ ](?:[ad]c|m/h))?|°[ ]?[cf]?|Ω|[^\W\d_]+/[a-z]+)(?![^\W_]))
      | (\d++(?:[.,:/-]\d++)*+(?!\w))
      | ((?:[^\W\d_]+-)*[^\W_]*\d[\w/]*(?:\([A-Za-z]\))?)
      | ([ \t\xa0]*[\r\n]+\s*)
      | ([.!?…])
      | (\#\w+)
      | [^\w\s]
      | [^\W\d_]+""",
    re.X,
)
WORD, VALUE, NUM, CODE, LINE, STOP, HASH = range(1, 8)
_CLASS = {w: k for k, words in reversed(FUNCTION_WORDS.items()) for w in words.split()}
_MARKS = {",": ",", ";": ",", ":": ":", "(": "(", ")": "(", "[": "(", "]": "("} | dict.fromkeys("|/·>•*<=#~_–—-+&", "|")
_PLAIN = {HASH: "H", VALUE: "V", NUM: "N", CODE: "K"}

_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_TWICE = re.compile("[\u00c2\u00c3][\u0080-\u00bf]")
_WRAP = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n(?=[^\W\d_])")
_LEAD = re.compile(r"^[ \t]*(?:\d{1,3}[.)]|\d{4}-\d\d-\d\d[ T]\d\d:\d\d(?::\d\d)?)[ \t]+", re.M)


def repaired(text: str) -> str:
    """Without invisible characters, letters encoded twice, words broken at line ends, list numbers and times before a line."""
    t = _INVISIBLE.sub("", text)
    if "\u00c3" in t or "\u00c2" in t:
        t = _TWICE.sub(lambda m: m.group().encode("latin-1").decode("utf-8", "replace"), t)
    return _LEAD.sub("", _WRAP.sub("", t))


class Words(dict):
    """(class of a function word or '', stem) of a word as written; kept for the words a worker meets."""

    def __missing__(self, word: str) -> tuple[str, str]:
        w = word.lower()
        if len(self) > 200_000:
            self.clear()
        self[word] = got = (_CLASS.get(w, ""), w[:-1] if w.endswith("s") else w)
        return got


_words = Words()


class Reader:
    """Collects the segments of one text."""

    def __init__(self) -> None:
        self.out: list[tuple[str, int, str]] = []
        self.recent: list[str] = []
        self.cur: list[str] = []
        self.said: list[str] = []
        self.size = 0

    def close(self) -> None:
        if self.cur:
            self.out.append(("".join(self.cur), self.size, " ".join(self.said)))
            self.cur, self.said, self.size = [], [], 0

    def read(self, text: str, start: int, stop: int) -> None:
        """The tokens of a stretch without links."""
        cur, said, recent = self.cur, self.said, self.recent
        size, run = self.size, 0
        for m in _TOKEN.finditer(text, start, stop):
            kind = m.lastindex
            if kind == WORD:
                t = m[1]
                size += len(t)
                k, stem = _words[t]
                said.append(stem)
                if k:
                    cur.append(k)
                    run = 0
                    continue
                cur.append("R" if stem in recent else "12345"[run])
                run = min(run + 1, 4)
                recent.append(stem)
                if len(recent) > MEMORY:
                    del recent[0]
                continue
            closes = False
            if kind == LINE:
                nxt = text[m.end() : m.end() + 1]
                # A line that breaks off inside a sentence does not break its run of words.
                closes = bool(cur) and (cur[-1] == "V" or not (nxt.islower() or nxt.isdigit()))
            else:
                t = m.group()
                size += len(t)
                run = 0
                if kind == STOP:
                    cur.append(".")
                    closes = len(cur) >= SENTENCE and (m.end() >= len(text) or text[m.end()].isspace())
                elif kind is None:
                    cur.append(_MARKS.get(t, "'"))
                else:
                    cur.append(_PLAIN[kind])
                    said.append(t)
            if closes:
                self.size = size
                self.close()
                cur, said, size, run = self.cur, self.said, 0, 0
        self.size = size


def segments(text: str) -> list[tuple[str, int, str]]:
    """(symbols, characters, words) of each segment: a sentence, a line, or a link by itself.

    A line that ends in neither a full stop nor a measured value goes on if the next one begins with a small letter or a digit."""
    text = repaired(text)
    r, at = Reader(), 0
    if _DOTTED.search(text):
        for m in _LINK.finditer(text):
            r.read(text, at, m.start())
            r.close()
            r.out.append(("U", m.end() - m.start(), m.group()))
            at = m.end()
    r.read(text, at, len(text))
    r.close()
    return r.out


def symbol_table(docs: DataFrame) -> DataFrame:
    """(doc_id, symbols, lengths, sizes, repeats): of every text with any segment its symbols, and for each segment its symbols and characters and how many different ones stood before it if it repeats one of them, else 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"]):
                segs = segments(t)
                if segs:
                    seen: set[str] = set()
                    repeats = []
                    for _, _, w in segs:
                        repeats.append(len(seen) if w in seen else 0)
                        seen.add(w)
                    rows.append((i, "".join([s for s, _, _ in segs]), [len(s) for s, _, _ in segs], [n for _, n, _ in segs], repeats))
            yield pd.DataFrame(rows, columns=["doc_id", "symbols", "lengths", "sizes", "repeats"])

    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.mapInPandas(run, "doc_id bigint, symbols string, lengths array<int>, sizes array<int>, repeats array<int>")


ALPHABET = [*sorted(set(SYMBOLS.values())), "$", "^"]
A = len(ALPHABET)
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = range(A)
END, START = A - 2, A - 1


def _is(symbols: str) -> np.ndarray:
    table = np.zeros(A, np.int64)
    table[[ALPHABET.index(c) for c in symbols]] = 1
    return table


CONTENT, FUNCTION, MEASURED, LINKED = _is("12345R"), _is("dpcnvb"), _is("V"), _is("HU")
TYPES = ("prose", "record")


@dataclass
class Windows:
    """All windows of a batch of texts, as arrays. trigrams are the codes of every symbol with the two before it and, at `ends`, of the end of a segment."""

    trigrams: np.ndarray
    ends: np.ndarray  # code of the end's trigram by window, -1 where the segment goes on
    starts: np.ndarray  # first symbol by window
    counts: np.ndarray  # symbols by window
    chars: np.ndarray
    kind: np.ndarray  # 0 prose, 1 record
    trains: np.ndarray
    doc: np.ndarray
    repeat: np.ndarray

    def bits(self, models: np.ndarray) -> np.ndarray:
        """Bits of each window under its type's model, ends of segments included."""
        m = models[np.repeat(self.kind, self.counts), self.trigrams]
        total = np.add.reduceat(m, self.starts)
        return total + np.where(self.ends >= 0, models[self.kind, np.maximum(self.ends, 0)], 0.0)

    @property
    def steps(self) -> np.ndarray:
        return self.counts + (self.ends >= 0)

    @property
    def size_class(self) -> np.ndarray:
        return np.searchsorted(LENGTHS, self.counts)


def windows(b: pd.DataFrame) -> Windows:
    """The windows of a batch of the symbol table (not empty)."""
    lengths = np.concatenate(b["lengths"].to_list()).astype(np.int64)
    sizes, repeat = np.concatenate(b["sizes"].to_list()).astype(float), np.concatenate(b["repeats"].to_list())
    doc = np.repeat(np.arange(len(b)), [len(x) for x in b["lengths"]])
    codes = _CODE[np.frombuffer("".join(b["symbols"]).encode("ascii"), np.uint8)]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    one, two = np.concatenate([[START], codes[:-1]]), np.concatenate([[START, START], codes[:-2]])[: len(codes)]
    one[first] = START
    two[first] = START
    second = first[lengths > 1] + 1
    two[second] = START
    trigrams = (two * A + one) * A + codes
    last = first + lengths - 1
    closing = (one[last] * A + codes[last]) * A + END
    # Windows of one segment differ by one symbol at most.
    parts = np.where(lengths <= WINDOW * 4 // 3, 1, -(-lengths // WINDOW))
    seg = np.repeat(np.arange(len(lengths)), parts)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(parts) - parts, parts)
    low, high = k * lengths[seg] // parts[seg], (k + 1) * lengths[seg] // parts[seg]
    starts, counts = first[seg] + low, high - low
    sums = lambda table: np.add.reduceat(table[codes], starts)
    content, function, measured, linked = sums(CONTENT), sums(FUNCTION), sums(MEASURED), sums(LINKED)
    words = content + function
    kind = ((measured > 0) & (linked == 0) & (words <= RECORD * measured) & (function < PROSE * np.maximum(words, 1))).astype(np.int64)
    stopped = (codes[last] == ALPHABET.index("."))[seg]
    valued = (codes[last] == ALPHABET.index("V"))[seg] & (sums(_is(",")) == 0)
    trains = np.where(kind == 1, valued, stopped & (linked == 0) & (words >= 5) & (words >= SPOKEN * counts) & (function >= PROSE * words))
    return Windows(trigrams, np.where(high == lengths[seg], closing[seg], -1), starts, counts, sizes[seg] * counts / lengths[seg], kind, trains, doc[seg], repeat[seg])


def model_of(counts: np.ndarray) -> np.ndarray:
    """Bits of every trigram: interpolated shares of trigram, bigram and unigram."""
    three = counts.reshape(A, A, A).astype(float)
    two, uni = three.sum(0), three.sum((0, 1))
    share = lambda x: np.divide(x, x.sum(-1, keepdims=True), out=np.zeros_like(x), where=x.sum(-1, keepdims=True) > 0)
    p = 0.8 * share(three) + 0.15 * share(two)[None] + 0.05 * ((uni + 0.5) / (uni.sum() + 0.5 * A))[None, None]
    return -np.log2(p).reshape(-1)


def train(table: DataFrame) -> np.ndarray:
    """The two trigram models, one row each, of all training windows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * A**3, np.int64)
        for b in batches:
            if len(b):
                w = windows(b)
                on = np.repeat(w.trains, w.counts)
                total += np.bincount(np.repeat(w.kind, w.counts)[on] * A**3 + w.trigrams[on], minlength=2 * A**3)
                closed = w.trains & (w.ends >= 0)
                total += np.bincount(w.kind[closed] * A**3 + w.ends[closed], minlength=2 * A**3)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"trigram": some, "n": total[some]})

    got = table.select("symbols", "lengths", "sizes", "repeats").mapInPandas(count, "trigram bigint, n bigint").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(2 * A**3)
    counts[got["trigram"].to_numpy(int)] = got["n"]
    return np.stack([model_of(c) for c in counts.reshape(2, -1)])


def ranges(table: DataFrame, models: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) normal bits of a symbol by type and length class, from a histogram of the training windows (steps of 0.01 bits)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for b in batches:
            if len(b):
                w = windows(b)
                bins = (w.bits(models) / w.steps * 100).astype(int)
                parts.append(pd.DataFrame({"kind": w.kind, "size": w.size_class, "bin": bins})[w.trains].value_counts().rename("n").reset_index())
        yield pd.concat(parts).groupby(["kind", "size", "bin"], as_index=False).sum() if parts else pd.DataFrame({"kind": [], "size": [], "bin": [], "n": []})

    counted = table.select("symbols", "lengths", "sizes", "repeats").mapInPandas(count, "kind bigint, size bigint, bin bigint, n bigint")
    hist = counted.groupBy("kind", "size", "bin").agg(F.sum("n").alias("n")).toPandas()
    low, high = np.zeros((2, len(LENGTHS) + 1)), np.full((2, len(LENGTHS) + 1), math.inf)
    for kind in (0, 1):
        of_kind = hist[hist["kind"] == kind] if (hist["kind"] == kind).any() else hist
        every = of_kind.groupby("bin")["n"].sum().sort_index()
        for size in range(len(LENGTHS) + 1):
            own = of_kind[of_kind["size"] == size].groupby("bin")["n"].sum().sort_index()
            own = own if own.sum() >= ENOUGH else every
            if len(own):
                share = own.cumsum() / own.sum()
                low[kind, size] = own.index[np.searchsorted(share, TAIL)] / 100
                high[kind, size] = (own.index[min(len(own) - 1, np.searchsorted(share, 1 - TAIL))] + 1) / 100
    return low, high


def score_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, bits, abnormal_share, flagged): mean bits of a symbol, repeated segments counted by what names them, share of the characters in abnormal windows, and whether the page is one of keywords, links or tags."""
    table = keep(symbol_table(docs))
    models = train(table)
    low, high = ranges(table, models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            w = windows(b)
            spent = w.bits(models)
            mean, size = spent / w.steps, w.size_class
            odd = (mean < low[w.kind, size]) | (mean > high[w.kind, size])
            total, abnormal = np.bincount(w.doc, w.chars), np.bincount(w.doc, w.chars * odd)
            # A repeated segment costs what names it among the different ones before it, shared by its windows.
            named = np.where(w.repeat > 0, np.minimum(spent, np.log2(w.repeat + 1.0) * w.steps / np.maximum(w.steps, WINDOW)), spent)
            symbols = np.bincount(w.doc, w.steps)
            bits, share = np.bincount(w.doc, named) / symbols, abnormal / total
            same = np.bincount(w.doc, w.chars * ((w.repeat > 0) & (w.kind == 0))) / total
            flagged = (share > 0.5) | ((same > SAME) & (symbols >= LEAST))
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "bits": bits.round(4), "abnormal_share": share.round(4), "flagged": flagged})

    return table.mapInPandas(run, "doc_id bigint, bits double, abnormal_share double, flagged boolean")
