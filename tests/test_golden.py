"""Values worked out by hand, on tables of a few rows."""

import pytest

import __spark_entry__ as entry
from tessella.plans.dialect import SparkDialect
from tessella.plans.texts import windows

Q = "id string, question string, ground_truth string, contexts string, category string, query_class string, reasoning_type string, source_product string, source_fields string, source_split string, generation_method string, support_notes string"
P = "id string, answer string, retrieved_contexts string, latency_ms long, model_name string, run_id string, timestamp_utc string"
LONG = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("golden")
    asked = [
        ("1", "Which amplifier drives the speakers?", "DAA2 amplifier drives them", '["The DAA2 amplifier drives the speakers."]', "c", "local_specific", None, "DAA2 amplifier", None),
        ("2", "What is missing?", "Nothing known", "[]", "c", "multi_hop", None, "lost panel", '["a_b", "c_d"]'),
        ("3", "What of both?", LONG, '["x", "y"]', "c", "multi_hop", None, "one|two", '["f_a", "f_b"]'),
    ]
    spark.createDataFrame([(*r, None, None, None) for r in asked], Q).write.parquet(f"{d}/autoq_questions.parquet")
    said = [
        ("1", "The DAA2 amplifier drives them", '["The DAA2 amplifier drives the speakers."]', 10, "graph_walk"),
        ("1", "Something else entirely", '["About doors."]', None, "dense_small"),
        ("2", "Not found in provided context. (Error code: 429 rate limit)", "[]", 5, "graph_walk"),
        ("2", "Nothing known of the lost panel", '["Nothing known of the lost panel: a b and c d."]', 6, "dense_small"),
    ]
    spark.createDataFrame([(*r, "r", "2024-01-01") for r in said], P).write.parquet(f"{d}/predictions.parquet")
    texts = [(1, "The controller supports BACnet and operates at 24 VDC."), (2, "BACNET protocol. 24 Volts! BACnet."), (3, None), (4, "")]
    spark.createDataFrame([(i, t, "other", "p") for i, t in texts], "doc_id long, text string, doc_type string, product_name string").write.parquet(f"{d}/documents.parquet")

    def rows(name: str, *keys: str) -> dict:
        return {tuple(r[k] for k in keys): r for r in entry.queries()[name](spark, str(d)).collect()}

    return rows


def test_metrics_and_winner(run):
    r = run("o9_rows", "id")[("1",)]
    assert (r.graph_entity_recall, r.vector_entity_recall, r.winner, r.failure_mode) == (1.0, 0.0, "graph", "retrieval_missed_entities")
    # Of the words daa2, amplifier, drives and them, the context lacks the last.
    assert (r.graph_faithfulness, r.graph_answer_correctness, r.graph_context_precision) == (0.75, 1.0, 1.0)
    lost = run("o9_rows", "id")[("2",)]
    assert (lost.graph_faithfulness, lost.graph_answer_correctness, lost.winner) == (0.0, 0.0, "vector")


def test_audit_and_queue(run):
    bad = run("q1_audit", "id", "system")[("2", "graph")]
    assert bad.answer_error and bad.answer_not_found and bad.quality_flags == "answer_error;answer_not_found;context_empty"
    assert run("q1_audit", "id", "system")[("3", "graph")].missing_prediction
    assert "vector_won_hard_query" in run("q3_queue", "id")[("2",)].review_reasons
    assert run("q10_flags", "id")[("1",)].graph_flags == ""


def test_difficulty(run):
    r = run("q4_difficulty", "id")
    # 1 + 2 for the class, 1 each for two entities, two fields, two contexts, a long reference: cut to 5.
    assert (r[("3",)].difficulty_score, r[("3",)].difficulty_band) == (5, "very_hard")
    assert r[("1",)].difficulty_score == 1


def test_cost_and_coverage(run):
    r = run("q6_audit", "model_name")
    assert r[("dense_small",)].latency_not_supplied == 1 and r[("graph_walk",)].latency_ms == 15
    assert run("o11_coverage", "id")[("1",)].entity_coverage == 1.0
    assert run("o13_contain", "id")[("1",)].better == "graph"


def test_votes_and_disagreement(run):
    assert run("o14_vote", "id")[("1",)].metrics_winner == "graph"
    assert run("q5_rows", "id")[("1",)].flags == ""
    assert run("o15_stage", "id")[("1",)].stage == "correct" and run("o15_stage", "id")[("2",)].stage == "retrieval_miss"


def test_small_classes(run):
    assert {r.status for r in run("stat1_bootstrap", "query_class", "metric").values()} == {"insufficient_n_for_ci"}


def test_entities_and_relations(run):
    e = run("e1_entities", "doc_id")
    assert (e[(1,)].protocols, e[(1,)].voltages, e[(1,)].components) == ("bacnet", "24v", "controller")
    assert (e[(2,)].protocols, e[(2,)].voltages) == ("bacnet", "24v") and e[(4,)].products == ""
    t = run("l2_typed", "src", "dst")
    assert t[("controller", "bacnet")].relation == "supports_protocol" and t[("controller", "bacnet")].confidence == 0.92
    assert t[("controller", "24v")].relation == "requires_voltage" and t[("controller", "24v")].confidence == 0.94
    assert run("l1_cooc", "src", "dst")[("24v", "bacnet")].weight == 2


def test_windows(spark):
    spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(12)))], "doc_id long, text string").createOrReplaceTempView("golden_docs")
    q = SparkDialect("", spark)
    q.t = lambda name: "golden_docs"
    got = spark.sql(f"with {windows(q, 5, 2)} select chunk_id, array_join(words, ' ') as words from chunks order by chunk_id").collect()
    assert [r.words for r in got] == ["w0 w1 w2 w3 w4", "w3 w4 w5 w6 w7", "w6 w7 w8 w9 w10", "w9 w10 w11"]
    assert [r.chunk_id[-4:] for r in got] == ["0000", "0001", "0002", "0003"]


def test_ranking_and_answers(run):
    assert run("k17_rank", "id", "model_name")[("1", "graph_walk")].k == 1
    assert run("k18_extract", "id", "model_name")[("1", "graph_walk")].answer == "The DAA2 amplifier drives the speakers."
    g = run("k19_grounded", "id", "model_name")
    assert g[("1", "graph_walk")].state == "used" and g[("1", "dense_small")].state == "unused"
