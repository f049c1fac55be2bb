"""Whole results: queries against brute force on small fixtures, where a filter or a cap once left rows out."""

from collections import Counter
from datetime import datetime
from itertools import combinations

import __spark_entry__ as entry
import tessella.operators.packed as packed
from tessella.operators.graph import components
from tessella.operators.wide import widen

PARTS = [(1, "Red Bolt", "A", 1), (2, "red bolt ", "A", 7), (3, "red bolt", "B", 7), (4, "red bolt", "A", 9), (5, "nut", "B", 3), (6, "NUT", "B", 1), (7, "nut", None, 2), (8, "nut", None, 2), (9, "pin", "A", 1), (10, None, "A", 1), (11, "red bolt", "B", 1)]


def write(spark, folder, name, rows, schema) -> str:
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def linked(spark, pairs) -> set:
    """All pairs of nodes that some pairs connect."""
    own = {r.node: r.component for r in components(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()}
    return {(a, b) for a, b in combinations(sorted(own), 2) if own[a] == own[b]}


def test_duplicates_of_all_sizes(spark, tmp_path):
    d = write(spark, tmp_path, "part", PARTS, "p_partkey long, p_name string, p_brand string, p_size int")
    write(spark, tmp_path, "lineitem", [(p[0], 1) for p in PARTS] + [(4, 2)], "l_partkey long, l_suppkey long")
    pairs = [(a, b) for a, b in combinations(PARTS, 2) if a[1] and b[1] and a[1].strip().lower() == b[1].strip().lower()]
    named = {(a[0], b[0]) for a, b in pairs}
    alike = {(a[0], b[0]) for a, b in pairs if a[2] and a[2] == b[2]}
    run = lambda name: entry.queries()[name](spark, d).collect()
    assert {(r.a, r.b) for r in run("f7_self_ineq")} == named
    got = run("n1_pairs")
    assert linked(spark, [(r.a, r.b) for r in got]) == named
    assert linked(spark, [(r.a, r.b) for r in got if r.kind == "same_label"]) == alike
    assert {(r.a, r.b) for r in got} <= named and len({(r.a, r.b) for r in got}) == len(got)
    assert {(r.a, r.b, r.confidence) for r in run("n2_exact")} == {(r.a, r.b, "high" if r.kind == "same_label" else "low") for r in got}
    assert {(r.node, r.component, r.size) for r in run("n6_clusters")} == {(1, 1, 3), (2, 1, 3), (4, 1, 3), (3, 3, 2), (11, 3, 2), (5, 5, 2), (6, 5, 2)}
    assert {(r.part, r.l_suppkey) for r in run("n7_merge")} == {(1, 1), (1, 2), (3, 1), (5, 1), (7, 1), (8, 1), (9, 1), (10, 1)}


def test_pairs_of_weight_one(spark, tmp_path):
    orders = {1: [1, 2, 3, 2], 2: [2, 1], 3: [4], 4: [5, 4]}
    write(spark, tmp_path, "lineitem", [(o, p) for o, ps in orders.items() for p in ps], "l_orderkey long, l_partkey long")
    d = write(spark, tmp_path, "documents", [(1, "AB123 sensor"), (2, "AB123 sensor, panel"), (3, "panel"), (4, None)], "doc_id long, text string")
    weights = Counter(pair for ps in orders.values() for pair in combinations(sorted(set(ps)), 2))
    assert {(r.a, r.b): r.weight for r in entry.queries()["f8_pairs"](spark, d).collect()} == weights
    got = {(r.src, r.dst): (r.weight, r.first_doc) for r in entry.queries()["l1_cooc"](spark, d).collect()}
    assert got == {("ab123", "sensor"): (2, 1), ("ab123", "panel"): (1, 2), ("panel", "sensor"): (1, 2)}


def test_values_beyond_the_dictionary_keep_their_weights(spark, monkeypatch):
    rows = [("f", f"c{i}", "common|usual") for i in range(8)] + [("f", "q", '"short, open"|rare one'), ("f", "j", "short, open|rare two"), ("f", "k", "short, open"), ("f", "l", '"short, open"')]
    texts = spark.createDataFrame(rows, "field string, row_key string, text string")
    products = spark.createDataFrame([], "product_name string")
    run = lambda: {tuple(r) for r in packed.split_packed(texts, products).collect()}
    whole = run()
    assert ("f", "j", 1, "short, open") in whole
    for most in (1, 2, 4):
        monkeypatch.setattr(packed, "DICTIONARY", most)
        assert run() == whole


def test_all_texts_that_did_not_cast(spark):
    catalog = spark.createDataFrame([("rated_power", "quantity", "power"), ("release_date", "date", None)], "field_name string, value_type string, quantity string")
    products = spark.createDataFrame([("A",), ("B",)], "product_name string")
    texts = [("A", "rated_power", "plenty"), ("A", "rated_power", "5 W"), ("A", "rated_power", "3 kg"), ("A", "rated_power", "n/a"), ("A", "release_date", "one day"), ("A", "release_date", "not a day"), ("B", "rated_power", "6 W")]
    rows = [(f"r{i}", *x, None, datetime(2024, 1, i + 1)) for i, x in enumerate(texts)]
    records = spark.createDataFrame(rows, "record_id string, product_name string, field_name string, field_value string, evidence_text string, extracted_at timestamp_ntz")
    got = {r.product_name: r for r in widen(records, products, catalog).collect()}
    assert (got["A"].rated_power, got["B"].rated_power) == (5000, 6000)
    assert got["A"].cast_failures == {"rated_power": "3 kg", "release_date": "not a day"}
    assert got["A"].all_cast_failures == {"rated_power": ["3 kg", "plenty"], "release_date": ["not a day", "one day"]}
    assert not got["B"].all_cast_failures


def test_names_and_values_of_many_atoms_stay_whole(spark, monkeypatch):
    name, value = "a, b, c, d, e, f", "red, blue, green, white, black and grey"
    rows = [("f", "n", f"{name}|x"), ("f", "m", f"{name}, {name}"), ("f", "u", f"{value}, other"), *[("f", f"q{i}", f'"{value}"') for i in range(9)], ("f", "v", "p, q, r, s, t, u")]
    texts = spark.createDataFrame(rows, "field string, row_key string, text string")
    products = spark.createDataFrame([(name,), (None,), ("plain",)], "product_name string")
    for most in (packed.NAMES, 0):
        monkeypatch.setattr(packed, "NAMES", most)
        got = {}
        for r in sorted(packed.split_packed(texts, products).collect(), key=lambda r: r.pos):
            got.setdefault(r.row_key, []).append(r["item"])
        assert got == {"n": [name, "x"], "m": [name, name], "u": [value, "other"], "v": list("pqrstu")}
