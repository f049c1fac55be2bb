"""The operators on training text, against brute force, exact round trips and stated cases."""

import itertools
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessella.llm.mixing import mix, plan, route
from tessella.llm.neardup import alike_pairs
from tessella.llm.pairs import SuffixAutomaton, coverage, defect, find_defects
from tessella.llm.stuffing import repaired, score_pages, segments
from tessella.llm.tokens import BYTE_BPE, TOKENIZERS, byte_table, decode, encode, encode_with_offsets, id_bytes, round_trip

QUESTION = "Under work order 120595, what rated power must the surveyor note down for the ZEN-100 pull station at depot G1 near Corrin, line 34207?"


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (None, "empty"),
        (" \n", "empty"),
        ('""', "empty"),
        ("TBD", "empty"),
        ("Answer:", "empty"),
        ("Unable to answer.", "refusal"),
        ("The supplied evidence is silent about the rated power, hence I can't help with that.", "refusal"),
        (QUESTION, "copied_question"),
        ("You asked: " + QUESTION.lower().replace("must the surveyor", "must surveyor"), "copied_question"),
        (QUESTION.rstrip("?") + ": it is 35 W.", None),
        ("Il valore è di 35 W e vale solo finché la linea 34207 non viene allungata", "other_language"),
        ("Its rated power is 35 W; the planner found this printed on pl", "truncated"),
        ("Its rated power is 35 W; the planner found this (printed", "truncated"),
        ("It is 35 W according to table row 7, provided that …", "truncated"),
        ('No; the sheet titled "Notice de pose" gives 35 W', None),
        ("Not 62 but 125 pascals", None),
        ("35 W (rated power)", None),
        ("0", None),
        ("No", None),
        ("85 to 264 V", None),
        ("the basement", None),
        ("The value is 35 W. " * 2000, None),
    ],
)
def test_defects(answer, want):
    assert defect(QUESTION, answer) == want


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("I'm afraid there is no way to tell from these pages.", "refusal"),
        ("That remains unanswered; the manual says nothing about it.", "refusal"),
        ("We are sorry, but this cannot be determined from the drawing.", "refusal"),
        ("Leider kann ich das mit den vorliegenden Seiten nicht beantworten.", "refusal"),
        ("Der Wert steht auf dem Schild neben der Klemme und gilt nur für diese Anlage.", "other_language"),
        ("La valeur est indiquée sur la plaque, elle dépend de la longueur du câble.", "other_language"),
        ("El valor se encuentra en la placa y depende de la longitud del cable.", "other_language"),
        ("Wartość podano na tabliczce obok zacisku, ale tylko dla tej linii.", "other_language"),
        ("According to the sheet, the pull station draws 35 W at full load.", None),
        ("It is not stated in watts but as 0.5 A at 70 V.", None),
    ],
)
def test_wordings_that_the_data_lack(answer, want):
    assert defect(QUESTION, answer) == want


def test_names_from_the_prompt_are_no_language():
    prompt = "What is the line impedance of the VX-1 and Base and the VX-2 and Base on the loop?"
    assert defect(prompt, "Enheten VX-1 and Base arbetar med 4 ohm; värdet står på skylten.") == "other_language"


def test_defect_without_prompt():
    assert defect(None, "Il valore è di 35 W e vale solo finché la linea non viene allungata.") is None
    assert defect(None, None) == "empty"


def test_suffix_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(2))
        inside = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = [max([n for n in range(1, k + 2) if tuple(b[k + 1 - n : k + 1]) in inside], default=0) for k in range(len(b))]
        assert SuffixAutomaton(a).matches(b) == want
    assert coverage(list("abcd"), list("abxcd")) == (0.8, 0)


def test_found_rows(spark):
    df = spark.createDataFrame([("1", QUESTION, None, "x"), ("1", QUESTION, None, "x"), ("2", QUESTION, "35 W", "x"), (None, None, None, "x")], "id string, question string, ground_truth string, defect string")
    assert [tuple(r) for r in find_defects(df).collect()] == [("1", "empty")]
    assert find_defects(df.limit(0)).count() == 0


def brute(rows, t=Fraction(7, 10)):
    sets = {i: set(re.findall(r"[^\W_]+", f"{q or ''} {a or ''}".lower())) for i, q, a in rows if i is not None}
    pairs = itertools.combinations(sorted(sets, key=int), 2)
    return {(a, b) for a, b in pairs if sets[a] | sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


@pytest.mark.parametrize("deletions", [None, True])
def test_near_duplicates_against_brute_force(spark, deletions):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(260):
        base = random.Random(i // 4)
        text = [base.choice(words) for _ in range(base.choice([2, 6, 14, 30, 70]))] + [f"code{i // 4 if rng.random() < 0.5 else i}"]
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rng.shuffle(text)
        rows.append((str(i + 1), " ".join(text[: len(text) // 2]), " ".join(text[len(text) // 2 :])))
    rows += [("901", None, None), ("902", "", ""), ("903", "Same TEXT here", None), ("904", "same text", "here"), ("905", "text same here", None), ("5", rows[4][1], rows[4][2])]
    df = spark.createDataFrame([(*r, "k") for r in rows], "id string, question string, ground_truth string, key string")
    assert {tuple(r) for r in alike_pairs(df, deletions=deletions).collect()} == brute(rows)


def test_crowded_signatures_are_not_compared_all_with_all(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from tessella.llm import neardup

    monkeypatch.setattr(neardup, "RARE_BUDGET", 3)
    monkeypatch.setattr(neardup, "SEGMENT_BUDGET", 40)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        text = [w for w in words if rng.random() < 0.9] + [f"c{i if rng.random() < 0.8 else i // 2}x{k}" for k in range(0 if i % 100 == 0 else 9)]
        rows.append((str(i + 1), " ".join(text), None))
    compared = []
    real = neardup._meet

    def meet(*given):
        left, right = [x for x in given if isinstance(x, DataFrame)][0], [x for x in given if isinstance(x, DataFrame)][-1]
        n = lambda df, name: df.groupBy("sig").agg(F.count("*").cast("long").alias(name))
        compared.append(n(left, "n").join(n(right, "m"), "sig").agg(F.coalesce(F.sum(F.expr("n * m")), F.lit(0))).first()[0])
        return real(*given)

    monkeypatch.setattr(neardup, "_meet", meet)
    got = {tuple(r) for r in alike_pairs(spark.createDataFrame(rows, "id string, question string, ground_truth string")).collect()}
    assert got == brute(rows) and len(got) > 30
    assert compared[-1] < 300 * 300 / 4, compared  # the join of crowded signatures


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, question string, ground_truth string")
    assert alike_pairs(df).count() == 0


TEXTS = [(1, None), (2, ""), (3, "Set the switch.\r\n\tNow!"), (4, "<|endoftext|> ça 🚨 日本語 ​ é"), (5, "x" * 50_000), (6, "a\x00b"), (6, "a\x00b")]


def test_tokens_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "ids") for i, t in TEXTS], "doc_id bigint, text string, ids string")
    ids = encode(docs)
    assert {r.doc_id: r.ids for r in ids.collect() if r.doc_id < 3} == {1: [], 2: []}
    assert 50256 not in next(r.ids for r in ids.collect() if r.doc_id == 4)
    assert sorted((r.doc_id, r.text) for r in decode(ids).collect()) == sorted((i, t or "") for i, t in TEXTS)
    assert encode(docs.limit(0)).count() == 0


def test_round_trip_in_one_pass(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id bigint, text string, same string")
    got = round_trip(docs).collect()
    assert len(got) == len(TEXTS) and all(r.same for r in got)
    sizes = {r.doc_id: len(r.ids) for r in encode(docs).collect()}
    assert all(r.n_tokens == sizes[r.doc_id] for r in got)


def test_offsets_tile_the_text(spark):
    docs = spark.createDataFrame(TEXTS[3:4], "doc_id bigint, text string")
    r = encode_with_offsets(docs).first()
    known, raw = id_bytes(f"{TOKENIZERS}/{BYTE_BPE}"), TEXTS[3][1].encode()
    assert b"".join(known[i] for i in r.ids) == raw
    assert all(raw[s : s + len(known[i])] == known[i] for s, i in zip(r.byte_starts, r.ids))
    assert all(a < b for a, b in zip(r.char_starts, r.char_ends))
    assert len(byte_table()) == 256


def test_route_of_overlapping_sources():
    patterns = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    size, flows = route(patterns, {"a": (0.5, 1), "b": (0.5, 2), "none": (0.3, 1)})
    into = {s: sum(v for (p, t), v in flows.items() if t == s) for s in "ab"}
    # The solver stops within a thousandth of a token.
    assert into["a"] == pytest.approx(into["b"], abs=2e-3) and size == pytest.approx(sum(into.values()), abs=2e-3)
    assert all(sum(v for (q, _), v in flows.items() if q == p) <= 2 * n + 1e-6 for p, n in patterns.items())
    assert all(whole >= 0 and stop >= start for _, _, whole, start, stop, _ in plan(patterns, flows))


def test_mix_keeps_shares_and_caps(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["relay", "panel", "zone"]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(30), s) for i, s in enumerate(["big"] * 300 + ["Small "] * 40 + [None] * 3 + ["other"] * 5)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats bigint")
    uses, report = mix(docs, targets)
    got = {r.source: r for r in report.collect()}
    assert got["small"].most_repeats == 3 and got["big"].most_repeats == 1 and got["gone"].tokens == 0
    assert abs(got["small"].actual_share - 0.4) < 0.02
    assert mix(docs.limit(0), targets)[0].count() == 0


def test_mix_of_real_documents(spark):
    """Every cap is kept and every share reached but for a document on either side of a boundary."""
    docs, targets = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "mix_targets"))
    uses, report = mix(docs, targets)
    got = report.collect()
    caps = {r.source: r.max_repeats for r in got}
    most = uses.groupBy("source").agg(F.max("repeats").alias("r"), F.max("n_tokens").alias("n"), F.sum("repeats").alias("s")).collect()
    assert most and all(r.r <= caps[r.source] for r in most)
    total, longest = sum(r.tokens for r in got), max(r.n for r in most)
    assert sum(r.actual_share for r in got) == pytest.approx(1, abs=1e-4)
    # Shares move together with the total, so the sources' boundary documents add up.
    assert all(abs(r.deviation) <= 3 * longest / total + 2e-3 for r in got), [(r.source, r.deviation) for r in got]


def test_pages(spark):
    prose = "Before the handover, the planner walks every floor with a sound meter. Do not paint the cover, because the sensor needs free air. "
    rows = [(i, prose * 4 + f"Zone {i} covers the cellar and the stairs of the old wing.") for i in range(150)]
    rows += [(900, "horn strobe, cheap panel, horn strobe, panel deal, horn strobe sale, cheap panel, " * 12), (901, "http://a.example/x " * 40), (902, "#deal #sale #panel " * 30), (903, "air flow: 149 mm\nrated power: 24 V\n" * 20), (904, ""), (905, None), (906, "  ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as bits")
    assert {r.doc_id for r in score_pages(df).where("flagged").collect()} == {900, 901, 902}
    assert score_pages(df.limit(0)).count() == 0


STUFFED = {
    "values between commas": lambda w, r: ", ".join(f"{w()} {r.choice([12, 24, 48])} V" for _ in range(40)),
    "values and offers": lambda w, r: ", ".join(f"cheap {w()} 12 W best price" for _ in range(30)),
    "prices": lambda w, r: " | ".join(f"{w()} $ {r.randint(5, 99)}.99" for _ in range(40)),
    "one sentence": lambda w, r: "Buy the horn strobe for the control panel in Selmere. " * 42,
    "function words": lambda w, r: " ".join(r.choice("the of and to in for with best cheap buy".split()) for _ in range(150)),
    "bare domains": lambda w, r: " ".join(f"{r.choice(['cheap', 'new'])}-{r.choice(['horn', 'relay'])}.example" for _ in range(40)),
    "link titles": lambda w, r: "\n".join(f"{w().title()} Catalogue" for _ in range(40)),
    "marked links": lambda w, r: "\n".join(f"- [{w().title()}](http://a.example/{i})" for i in range(30)),
    "product tags": lambda w, r: "Filed under: " + ",".join(f"{w()} {r.choice(['sale', 'offer', 'deal'])}" for _ in range(60)),
    "codes": lambda w, r: "See also: " + " / ".join(f"VX-{r.randint(100000, 139999)}" for _ in range(60)),
}
SOUND = {
    "tables": lambda w, r: "\n".join(f"{k}: {r.randint(1, 900)} {u}" for k, u in r.sample([("Rated power", "W"), ("Air flow", "m³/h"), ("Housing depth", "mm"), ("Line impedance", "ohm"), ("Net weight", "g"), ("Standby current", "mA")], 6)),
    "logs": lambda w, r: "\n".join(f"2025-03-{r.randint(10, 28)} 12:{r.randint(10, 59)} The panel in zone {r.randint(1, 60)} was reset by the guard after {r.randint(2, 50)} seconds." for _ in range(15)),
    "links with sentences": lambda w, r: "\n".join(f"http://a.example/{i} This page explains how the zones are grouped and which of them may share a riser." for i in range(8)),
}


def test_page_families_that_the_data_lack(spark):
    """Families of pages written for this test, among real documents: recall at least 0.95 of each, no sound page flagged but by chance."""
    rng, rows, family = random.Random(3), [], {}
    names = [f"{a} {b}" for a in ("horn", "smoke", "control", "duct", "relay", "beam") for b in ("strobe", "panel", "sensor", "module")]
    for group in (STUFFED, SOUND):
        for name, make in group.items():
            for _ in range(20):
                rows.append((10**9 + len(rows), make(lambda: rng.choice(names), rng)))
                family[rows[-1][0]] = name
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id for r in score_pages(docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))).where("flagged").collect()}
    share = {n: sum(i in found for i, k in family.items() if k == n) / 20 for n in family.values()}
    assert all(share[n] >= 0.95 for n in STUFFED), share
    assert all(share[n] <= 0.05 for n in SOUND), share


def test_repaired_text():
    assert repaired("comp-\nuerta rÃ©seau​") == "compuerta réseau"
    assert segments("") == []
