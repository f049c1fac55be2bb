"""Records for questions: every record scored for every question in one scan, the best kept.

A record's fields count as one text, in which a question's words, numbers, codes and phrases count as in `lexical`; a
record of a field that the question names gains FIELD, one of its products PRODUCT, and one of another product loses it.
Only records of the named fields are results; where none of them scores, all fields are.

Defined results: scores of 0 and below are no results; ties go to the smaller record id; records delivered twice count
once; null fields count as empty; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.additive import BLOCK, ROWS, Best, Postings, Weights
from tessella.operators.blocks import against
from tessella.operators.lexical import QUESTIONS, Question

# Words of a question that say nothing of a record; weights.
GENERIC = set("what are the and for with from that this land applications application space use uses used".split())
FIELD, PRODUCT, WORD, NUMBER, PHRASE = 18.0, 12.0, 2.5, 3.0, 8.0
TEXTS = ["product_name", "field_name", "field_value", "evidence_text", "section_header"]
RECORDS = 2_000_000  # records of a task that are scored together
SCHEMA = "id string, record_id string, named boolean, score double"


def hints(question: str, fields: list[str]) -> set[str]:
    """The catalogued fields all of whose words stand in a question."""
    q = question.lower()
    return {f for f in fields if (parts := [p for p in f.split("_") if p]) and all(p in q for p in parts)}


def record_score(q: Question, named: set[str], texts: dict[str, str], doc: str) -> float:
    """The score of one record, as the scan below computes it."""
    low = " ".join(texts[c] for c in TEXTS).lower()
    own = " ".join([texts["product_name"], doc, texts["evidence_text"], texts["field_value"]]).lower()
    score = FIELD * (texts["field_name"] in named) + WORD * sum(w in low for w in q.words - GENERIC) + NUMBER * sum(n in low for n in set(q.numbers)) + PHRASE * sum(p in low for p in q.phrases)
    return score + (PRODUCT if any(p in own for p in q.products) else -PRODUCT) * bool(q.products)


class Index:
    """The questions of one scan, and the scan: records in any number, the best k of each question among the records of named fields and among the others.

    Records that hold the same common features and have the same field score alike for all questions but those that share a
    rare feature or a code with them. So a class of records is scored once and stands for its k smallest ids; what rare
    features and codes add is added to single records. As they only add, the best are among these."""

    def __init__(self, pdf: pd.DataFrame, fields: list[str], k: int):
        import ahocorasick

        asked = [Question.of(t) for t in pdf["question"]]
        self.ids, self.k, self.n = pdf["id"].to_numpy(), k, len(asked)
        self.fields = {f: j for j, f in enumerate(fields)}
        self.features: dict[str, int] = {}
        who: list[int] = []
        which: list[int] = []
        weight: list[float] = []
        codes: dict[str, int] = {}
        code_who: list[int] = []
        code_which: list[int] = []
        self.named = np.zeros((len(asked), len(fields) + 1), np.float32)
        for i, (q, text) in enumerate(zip(asked, pdf["question"])):
            for group, w in ((q.words - GENERIC, WORD), (set(q.numbers), NUMBER), (q.phrases, PHRASE)):
                for x in group:
                    who.append(i)
                    which.append(self.features.setdefault(x, len(self.features)))
                    weight.append(2 * w)
            for x in q.products:
                code_who.append(i)
                code_which.append(codes.setdefault(x, len(codes)))
            self.named[i, [self.fields[f] for f in hints(text, fields)]] = 1

        def automaton(of: dict[str, int]):
            a = ahocorasick.Automaton()
            for x, f in of.items():
                a.add_word(x, f)
            if of:
                a.make_automaton()
            return a if of else None

        self.words, self.names = automaton(self.features), automaton(codes)
        self.weights = Weights(Postings(who, which, weight, len(self.features), len(asked)), len(asked))
        self.codes = Postings(code_who, code_which, [0.0] * len(code_who), len(codes), len(asked))
        self.coded = np.array([bool(q.products) for q in asked], bool)

    def stream(self, parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, seen = Best(2 * self.n, self.k), set()
        classes: dict[tuple, list[int]] = {}
        rare: list[tuple[int, tuple, tuple, tuple]] = []
        for part in parts:
            part = part.sort_values("record_id")
            for x in part[["record_id", "doc_id", *TEXTS]].fillna("").to_dict("records"):
                if x["record_id"] in seen:
                    continue
                seen.add(x["record_id"])
                low = " ".join(x[c] for c in TEXTS).lower()
                found = {f for _, f in self.words.iter(low)} if self.words is not None else set()
                common = tuple(sorted(f for f in found if self.common[f]))
                own = tuple({f for _, f in self.names.iter(" ".join([x["product_name"], x["doc_id"], x["evidence_text"], x["field_value"]]).lower())}) if self.names is not None else ()
                key = (self.fields.get(x["field_name"], len(self.fields)), common)
                row = len(best.ids)
                best.ids.append(x["record_id"])
                held = classes.setdefault(key, [])
                held.append(row)
                if len(held) > 4 * self.k:
                    self._least(held, best)
                others = tuple(f for f in found if not self.common[f])
                if others or own:
                    rare.append((row, key, others, own))
            if len(best.ids) > RECORDS or len(rare) > RECORDS:
                yield from self._scored(classes, rare, best)
                best, classes, rare = Best(2 * self.n, self.k), {}, []
        yield from self._scored(classes, rare, best)

    @property
    def common(self) -> list[bool]:
        if not hasattr(self, "_common"):
            self._common = (self.weights.column >= 0).tolist()
        return self._common

    def _least(self, held: list[int], best: Best) -> None:
        held.sort(key=lambda r: best.ids[r])
        del held[self.k :]

    def _scored(self, classes: dict[tuple, list[int]], rare: list, best: Best) -> Iterator[pd.DataFrame]:
        for held in classes.values():
            self._least(held, best)
        keys = sorted(classes, key=lambda c: best.ids[classes[c][0]])
        place = {c: i for i, c in enumerate(keys)}
        rare = sorted(rare, key=lambda x: place[x[1]])
        at_class = np.array([place[x[1]] for x in rare], np.int64)
        # Whole classes, each by its smallest id: the first k classes of a list hold its first k records but for what rare features add.
        top = Best(2 * self.n, self.k)
        top.ids = [best.ids[classes[c][0]] for c in keys]
        c = self.weights.columns
        for s in range(0, len(keys), ROWS):
            own = keys[s : s + ROWS]
            r, field = len(own), np.array([x[0] for x in own])
            x = np.zeros((r, c + len(self.fields) + 2), np.float32)
            for i, (f, common) in enumerate(own):
                x[i, self.weights.column[list(common)]] = 1
            x[np.arange(r), c + field] = 1
            x[:, -1] = 1
            some = rare[slice(*np.searchsorted(at_class, [s, s + r]))]
            row, of = np.array([y[0] for y in some], np.int64), np.array([place[y[1]] - s for y in some], np.int64)
            flat = lambda j: (np.fromiter((f for y in some for f in y[j]), np.int64), np.repeat(np.arange(len(some)), [len(y[j]) for y in some]))
            features, codes = flat(2), flat(3)
            for a in range(0, self.n, BLOCK):
                b = min(self.n, a + BLOCK)
                w = self.weights.block(a, b, len(self.fields) + 2)
                w[:, c:-1] = 2 * FIELD * self.named[a:b]
                w[:, -1] = -2 * PRODUCT * self.coded[a:b]
                scores = w @ x.T
                fits = self.named[a:b][:, field] > 0
                for kind in (0, 1):
                    top.offer(a + kind * self.n, scores, s, fits == bool(kind))
                if not len(some):
                    continue
                # Single records: what rare features add, and each code's product once.
                pairs, more = self.weights.postings.pairs(a // BLOCK, *features, len(some))
                coded = np.unique(self.codes.pairs(a // BLOCK, *codes, len(some))[0])
                pairs, back = np.unique(np.concatenate([pairs, coded]), return_inverse=True)
                total = np.bincount(back, np.concatenate([more, np.full(len(coded), 4 * PRODUCT)]), len(pairs)).astype(float)
                q, at = pairs // len(some), pairs % len(some)
                total += scores[q, of[at]]
                lists = a + q + self.n * fits[q, of[at]]
                good = total >= np.maximum(best.floor[lists], 1)
                best.add(lists[good], total[good], row[at[good]])
        q, s, i = top.cut()
        sizes = np.array([len(classes[x]) for x in keys], np.int64)[i] if len(keys) else np.zeros(0, np.int64)
        best.add(np.repeat(q, sizes), np.repeat(s, sizes), np.array([r for x in i for r in classes[keys[x]]], np.int64))
        for q, s, record in best.pieces():
            yield pd.DataFrame({"id": self.ids[q % self.n], "record_id": record, "named": q >= self.n, "score": s.astype(float) / 2})


def search_records(questions: DataFrame, records: DataFrame, catalog: DataFrame, k: int = 5) -> DataFrame:
    """(id, record_id, named, score, k) of the k best records of every question (id, question)."""
    fields = sorted(r.field_name for r in catalog.select("field_name").distinct().collect() if r.field_name)
    texts = records.select("record_id", "doc_id", *TEXTS).where("record_id is not null").coalesce(records.sparkSession.sparkContext.defaultParallelism)
    none = pd.DataFrame({"id": [], "record_id": [], "named": [], "score": []})
    asked = questions.select("id", "question").where("id is not null and question is not null")
    found = against(asked, texts, lambda p: Index(p, fields, k), lambda index, part: pd.concat([*index.stream([part])] or [none]), SCHEMA, "id", "record_id", (QUESTIONS, 8192, 100_000)).distinct()
    best = Window.partitionBy("id").orderBy(F.desc("named"), F.desc("score"), "record_id")
    some = F.max("named").over(Window.partitionBy("id"))
    return found.withColumn("some", some).where(F.col("named") | ~F.col("some")).withColumn("k", F.row_number().over(best).cast("bigint")).where(F.col("k") <= k).select("id", "record_id", "named", "score", "k")
