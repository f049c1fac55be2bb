"""Retrieval operators against plain scoring of every pair, and stages and lines worked out by hand."""

import random

import pytest

import tessella.operators.blocks as blocks
from tessella.operators import lexical
from tessella.operators.answers import best_line, cleaned, is_heading, relevant_lines, repaired_lines
from tessella.operators.lexical import Question, lexical_score, question_type, search
from tessella.operators.matching import contained
from tessella.operators.recordsearch import hints, record_score, search_records
from tessella.operators.staged import choose, final_score, staged

WORDS = "voltage rated input 24 12.5 capacity up to devices L-PCM RK-ZONE8 horn strobe power settings 1/4, compatible zone designed for offices where L12 volt Voltage spec".split()


def made(n: int, size: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, size))) for _ in range(n)]


@pytest.mark.parametrize("one", [4096, 3])
def test_search_is_that_of_all_pairs(spark, monkeypatch, one):
    asked = [(str(i), q) for i, q in enumerate([*made(14, 9, 1), "What is the rated input voltage of the L-PCM?", "", "How many?"])] + [("n", None)]
    chunks = [(f"c{i:03}", t, h, b, d) for i, (t, h, b, d) in enumerate(zip(made(80, 25, 2), ["", "specifications", None, "features"] * 20, ["general", "specification", None, "features"] * 20, ["1 rk-zone8", "2", None, "l12"] * 20))] + [("z", None, "", "", "")]
    if one == 3:
        real = blocks.against
        monkeypatch.setattr(lexical, "against", lambda *a: real(*a[:-1], (3, 3, 30)))
    df = spark.createDataFrame(chunks, "chunk_id string, text string, header string, block string, doc string")
    got = {}
    for r in sorted(search(spark.createDataFrame(asked, "id string, question string"), df, 4).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append((r.chunk_id, round(r.lexical, 6)))
    for i, q in asked:
        if q is None:
            continue
        scored = [(c, lexical_score(Question.of(q), t, h or "", b or "", d or "")) for c, t, h, b, d in chunks if t is not None]
        want = [(c, round(s, 6)) for c, s in sorted(scored, key=lambda x: (-x[1], x[0])) if s > 0][:4]
        assert got.get(i, []) == want
    assert search(spark.createDataFrame(asked, "id string, question string").limit(0), df, 4).count() == 0


def test_records_are_those_of_all_pairs(spark):
    catalog = spark.createDataFrame([("rated_voltage",), ("capacity",), ("color",)], "field_name string")
    asked = [("1", "What rated voltage has the L-PCM with 24?"), ("2", "Which color?"), ("3", "tell me of zone designed for"), ("4", "What rated voltage at unknown X-QQQQ?")]
    rng = random.Random(4)
    rows = [(f"r{i:03}", rng.choice(["d1", "l-pcm"]), rng.choice(["L-PCM", "RK-ZONE8", None]), rng.choice(["rated_voltage", "capacity", "other"]), t, t, None) for i, t in enumerate(made(60, 6, 5))]
    df = spark.createDataFrame([*rows, rows[0]], "record_id string, doc_id string, product_name string, field_name string, field_value string, evidence_text string, section_header string")
    got = {}
    for r in sorted(search_records(spark.createDataFrame(asked, "id string, question string"), df, catalog, 3).collect(), key=lambda r: r.k):
        got.setdefault(r.id, []).append((r.record_id, r.score))
    for i, q in asked:
        named = hints(q, ["rated_voltage", "capacity", "color"])
        scored = [(r[0], record_score(Question.of(q), named, dict(zip(["product_name", "field_name", "field_value", "evidence_text", "section_header"], [x or "" for x in r[2:]])), r[1]), r[3] in named) for r in rows]
        scored = [s for s in scored if s[1] > 0]
        scored = [s for s in scored if s[2]] or scored
        assert got.get(i, []) == [(s[0], s[1]) for s in sorted(scored, key=lambda s: (-s[1], s[0]))[:3]]


def test_contained(spark):
    names = spark.createDataFrame([("a", "Horn"), ("b", "horn strobe"), ("c", None), ("d", "")], "key string, name string")
    texts = spark.createDataFrame([(1, "A HORN strobe, a horn"), (2, None), (3, "none")], "key int, text string")
    assert {(r.name_key, r.text_key) for r in contained(names, texts).collect()} == {("a", "1"), ("b", "1")}


def row(name, text, **more):
    return {"chunk_id": name, "text": text, "header": "", "block": "", "doc": "", "doc_type": "", "sim": 0.0, "lexical": 0.0, "sim_rank": None, "lexical_rank": None, "sources": ""} | more


def test_stages():
    rows = [row("a", "the L-PCM has a rated input voltage of 24 V", sim=0.2, sim_rank=2), row("b", "another device with rated input voltage", sim=0.9, sim_rank=1), row("c", "l-pcm and nothing else", lexical=3.0, lexical_rank=1)]
    got = choose("What is the rated input voltage of the L-PCM?", "", rows)
    # Chunks of another product go; the phrase and its keyword score decide between the others.
    assert [r["chunk_id"] for r in got] == ["a", "c"]
    q = Question.of("What is the rated input voltage of the L-PCM?")
    assert got[0]["score"] == pytest.approx(final_score(q, "", rows[0]))
    # No wanted type among the first three: the most similar come first.
    weak = choose("general words", "datasheet", [row("x", "general words words", sim_rank=2), row("y", "zzz", sim_rank=1)], 2)
    assert [r["chunk_id"] for r in weak] == ["y", "x"]
    assert choose("anything", "", []) == []


def test_staged_rows(spark):
    chunks = spark.createDataFrame([("c1", "rated input voltage 24 V of the L-PCM", "", "", "", "datasheet"), ("c2", "rated input voltage", "", "", "", "manual"), ("c3", None, "", "", "", None)], "chunk_id string, text string, header string, block string, doc string, doc_type string")
    asked = spark.createDataFrame([("1", "rated input voltage of the L-PCM"), ("2", None)], "id string, question string")
    got = staged(asked, chunks).collect()
    assert [(r.id, r.place, r.chunk_id) for r in got] == [("1", 1, "c1")] and got[0].sources == "diversity|lexical|similarity"
    assert staged(asked.limit(0), chunks).count() == 0


def test_question_types():
    for q, kind in [("How many zones?", "capacity"), ("Which candela?", "enumerated_settings"), ("What voltage?", "single_numeric_spec"), ("Is it compatible?", "compatibility"), ("Where is it used?", "usage"), ("How to mount it?", "procedure"), ("Who?", "general")]:
        assert question_type(q) == kind


def test_lines():
    assert repaired_lines("Rated power\n24 W\r\nThe cover is\nred. Keep\n\nDimensions") == ["Rated power 24 W", "The cover is red. Keep", "Dimensions"]
    assert repaired_lines("It is small Rated power 5W") == ["It is small", "Rated power 5 W"]
    assert cleaned("::::::\n!!\nThe panel.\nPhotograph of it") == "The panel."
    assert is_heading("RK-ZONE8 expander") and is_heading("HORN STROBE") and not is_heading("- RK-ZONE8") and not is_heading("a plain line of words")
    text = "RK-ZONE8 Zone Expander\nSpecifications:\nWeight 3 kg\nRated input voltage 24 V\nL-PCM Speaker\nRated input voltage 70 V"
    assert relevant_lines("What is the rated input voltage of the RK-ZONE8?", text) == "Rated input voltage 24 V"
    assert relevant_lines("What is the weight spec of the RK-ZONE8 zone expander?", text).split("\n")[:3] == ["RK-ZONE8 Zone Expander", "Specifications:", "Weight 3 kg"]
    assert relevant_lines("anything", "") == ""
    assert best_line("How many devices?", "Up to 4 NFC\nup to 32 SLC") == ("Up to 32 SLC devices can be connected on one system.", 1e6)
    assert best_line("Who?", "no line can answer") == (None, 0.0)
    places = "It suits locations such as schools, hotels, warehouses and stadiums"
    assert best_line("Where is it used?", places)[0] == "locations such as schools, hotels, warehouses, and stadiums."
