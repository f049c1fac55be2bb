"""Units, wide tables and packed fields on small fixtures."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators.packed import item, lattice, packed_texts, scorer, split_packed, viterbi
from tessella.operators.units import UNITS, fit_mixture, normalise_units, on_axis, parse_quantities, unit_classes, with_units
from tessella.operators.wide import entity_key, unpivot, widen

RECORD = "record_id string, doc_id string, product_name string, field_name string, field_value string, evidence_text string, extracted_at timestamp_ntz, quantity string, key string"
CATALOG = "field_name string, value_type string, quantity string, common_unit string"
FIELDS = [
    ("rated_power", "quantity", "power", "W"),
    ("housing_depth", "quantity", "size", "mm"),
    ("duct_pressure", "quantity", "pressure", "Pa"),
    ("operating_temperature", "quantity_range", "temperature", "degC"),
    ("speaker_zones", "integer", None, None),
    ("push_to_talk", "boolean", None, None),
    ("release_date", "date", None, None),
    ("housing_color", "text", None, None),
    ("usage_locations", "list", None, None),
]


def at(n):
    return datetime.datetime(2024, 1, n)


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(FIELDS, CATALOG)


def records(spark, rows):
    """Rows of (product, field, value, evidence, day); extra columns clash with the operators' own names on purpose."""
    data = [(f"r{i}", "d", p, f, v, e, at(t) if t else None, "extra", "extra") for i, (p, f, v, e, t) in enumerate(rows)]
    return spark.createDataFrame(data, RECORD)


STATED = [
        ("rated_power", "1,250 mW", None, {"value": 1250}),
        ("ratedPower", "0,5 kW / 500 W", None, {"value": 500000}),
        ("Rated power (kW)", "0.5", None, {"value": 500000}),
        ("rated_power", "48", "RATED POWER: 48 Watts", {"value": 48000}),
        ("rated_power", "3/4 W at 70 V", None, {"value": 750}),
        ("housing_depth", "1 1/2″", None, {"value": 38100}),
        ("housing_depth", "(inches) 2", None, {"value": 50800}),
        ("housing-depth_in", "2", None, {"value": 50800}),
        ("housing_depth", "rated for 6,4\xa0cm in continuous duty", None, {"value": 64000}),
        ("rated_power", "twelve watts", None, {"value": 12000}),
        ("operating_temperature", "−13 °F ... 131 °F", None, {"low": -25000, "high": 55000}),
        ("operating_temperature", "-40-70 °C", None, {"low": -40000, "high": 70000}),
        ("operating_temperature", "between 263.15 and 333.15 K", None, {"low": -10000, "high": 60000}),
        ("duct_pressure", "1 psi", None, {"value": 6894757}),
        ("rated_power", "50 Hz", "rated power 50 Hz", {}),
        ("rated_power", "TBD", None, {}),
        ("rated_power", None, None, {}),
        ("rated_power", "", None, {}),
        (None, "5 W", None, {}),
        ("order_note1", "5 W", None, {}),
    ]


def test_stated_units(spark, catalog):
    rows = normalise_units(records(spark, [("A", f, v, e, 1) for f, v, e, _ in STATED]), catalog).collect()
    got = {i: {r.bound: r.common_milli for r in rows if r.record_id == f"r{i}" and r.unit_source != "inferred"} for i in range(len(STATED))}
    assert got == {i: want for i, (*_, want) in enumerate(STATED)}


def test_units_rows_twice_and_empty(spark, catalog):
    one = records(spark, [("A", "rated_power", "5 W", None, 1)])
    assert normalise_units(one.union(one), catalog).count() == 1
    assert normalise_units(one.limit(0), catalog).count() == 0


def test_inferred_units_on_held_out_accuracy():
    rng = np.random.default_rng(3)
    classes = unit_classes("power")
    offsets = np.log10([f for _, f, _ in classes])
    true = np.log10(rng.choice([5.0, 20.0, 60.0], 3000)) + rng.normal(0, 0.01, 3000)
    unit = rng.integers(0, len(classes), 3000)
    logs = true - offsets[unit]
    known = np.where(np.arange(3000) < 2400, unit, -1)
    places, jacobian, narrow, wide = on_axis("power", 10**logs)
    model = fit_mixture(places, jacobian, np.ones(3000), known, narrow, wide)
    post = model.posterior(places[2400:], jacobian)
    sure = post.max(1) >= 0.9
    assert sure.mean() > 0.9
    assert (post.argmax(1) == unit[2400:])[sure].mean() > 0.98


def test_hidden_units(spark):
    """A tenth of the stated units of real records hidden: what is not flagged must be right, by field and over all."""
    records, catalog = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("product_records", "field_catalog"))
    parsed = parse_quantities(records, catalog).distinct().where("unit is not null").withColumn("held", F.pmod(F.xxhash64("record_id"), F.lit(10)) == 0).cache()
    hidden = parsed.withColumns({c: F.when(~F.col("held"), F.col(c)) for c in ("unit", "unit_source", "milli")})
    truth = parsed.where("held").select("record_id", "bound", F.col("milli").alias("true_milli"))
    got = with_units(hidden.drop("held")).join(truth, ["record_id", "bound"]).toPandas()
    right = (got.common_milli - got.true_milli).abs() <= 1 + got.true_milli.abs() * 1e-6
    sure = ~got.uncertain
    print(f"{len(got)} hidden, {1 - sure.mean():.3f} flagged, {right[sure].mean():.3f} of the others right, {right[~sure].mean():.3f} of the flagged")
    assert len(got) > 200 and sure.mean() > 0.2
    assert right[sure].mean() >= 0.95


def test_units_without_evidence(spark, catalog):
    """Nothing stated: the unit stays undecided and flagged; 0 is 0 in any unit; temperatures are inferred too."""
    warm = [("A", "operating_temperature", f"{a} to {b} °C", None, 1) for a, b in ((-10, 50), (0, 49), (-5, 55), (-20, 60)) for _ in range(30)]
    warm += [("A", "operating_temperature", f"{a} to {b} °F", None, 1) for a, b in ((14, 122), (32, 120), (23, 131), (-4, 140)) for _ in range(30)]
    rows = [("A", "rated_power", "12", None, 1), ("A", "housing_depth", "0", None, 1), ("A", "operating_temperature", "14 to 122", None, 1), ("A", "operating_temperature", "263.15 to 323.15", None, 1), *warm]
    got = {(r.record_id, r.bound): r for r in normalise_units(records(spark, rows), catalog).collect()}
    assert got["r0", "value"].uncertain and got["r0", "value"].posterior == pytest.approx(1 / 3, abs=1e-3)
    zero = got["r1", "value"]
    assert (zero.common_milli, zero.uncertain, zero.unit) == (0, False, None)
    assert got["r2", "high"].unit == "f" and got["r2", "high"].common_milli == 50000
    assert all(got["r3", b].posterior is not None and got["r3", b].common_milli is not None for b in ("low", "high"))
    assert got["r3", "high"].uncertain or got["r3", "high"].unit == "k"


def test_every_unit_has_a_factor():
    assert all(f != 0 for us in UNITS.values() for f, _ in us.values())


def test_wide_table(spark, catalog):
    products = spark.createDataFrame([("VX-1, Rev A", "k", "p"), ("VX-2", "k", "p"), ("Z-9", "k", "p")], "product_name string, product_kind string, entity string")
    rows = [
        ("vx_1, rev a (R)", "rated_power", "5 W", None, 2),
        ("VX-1, Rev A", "rated_power", "N/A", None, 3),
        ("VX–1, Rev A", "speaker_zones", "Up to 1,000 zones", None, 1),
        ("VX-1, Rev A", "speaker_zones", "sixteen", None, None),
        ("VX-2™", "push_to_talk", "yes (standard)", None, 1),
        ("VX-2", "release_date", "May 3, 2021", None, 1),
        ("VX-2", "release_date", "not a day", None, 2),
        ("VX-2", "housing_color", " Light\xa0 Grey ", None, 1),
        (None, "housing_color", "red", None, 9),
        ("VX-2", "usage_locations", "a|b", None, 9),
    ]
    wide = widen(records(spark, rows), products, catalog)
    assert wide.count() == 3
    assert dict(wide.dtypes)["release_date"] == "date"
    assert {tuple(r) for r in unpivot(wide).collect()} == {
        ("VX-1, Rev A", "rated_power", "5000"),
        ("VX-1, Rev A", "speaker_zones", "1000"),
        ("VX-2", "push_to_talk", "true"),
        ("VX-2", "release_date", "2021-05-03"),
        ("VX-2", "housing_color", "light grey"),
    }
    assert wide.where("product_name = 'VX-2'").first().cast_failures == {"release_date": "not a day"}
    assert unpivot(widen(records(spark, rows).limit(0), products, catalog)).count() == 0


def test_ties_take_the_greatest_record(spark, catalog):
    products = spark.createDataFrame([("A", "k", "p")], "product_name string, product_kind string, platform string")
    got = unpivot(widen(records(spark, [("A", "housing_color", "red", None, 1), ("A", "housing_color", "white", None, 1)]), products, catalog)).collect()
    assert [r.cell for r in got] == ["white"]


def test_entity_key(spark):
    df = spark.createDataFrame([("AURA-700 (R)",), ("aura_700",), ("  ",), (None,)], "n string")
    assert [r.k for r in df.select(entity_key(df.n).alias("k")).collect()] == ["aura700", "aura700", None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a|b| |c|", ["a", "b", "c"]),
        ('P, Rev A and "x, y"', ["P, Rev A", "x, y"]),
        ("* a\n• b\n- c", ["a", "b", "c"]),
        ('["a_b", "c_d"', ["a_b", "c_d"]),
        ('"[\\"a_b\\", \\"c_d\\"]"', ["a_b", "c_d"]),
        ("{a_b,c_d}", ["a_b", "c_d"]),
        ("max_power tone_frequency", ["max_power", "tone_frequency"]),
        ("Class A (Style 6, Style 7) & Class N (ring; dual)", ["Class A (Style 6, Style 7)", "Class N (ring; dual)"]),
        ("1/4 W/3/4 W / 2 W", ["1/4 W", "3/4 W", "2 W"]),
        ('"""zone 0"" rooms", b', ['"zone 0" rooms', "b"]),
        ("'a, b';c", ["a, b", "c"]),
        ('"P" "Q"', ["P", "Q"]),
        ("a, b, and c", ["a", "b", "c"]),
    ],
)
def test_split(text, want):
    atoms, cuts = lattice(text, {"P, Rev A"}.__contains__)
    assert [v for v in viterbi(atoms, cuts, scorer({})) if v] == want


def test_item_marks():
    assert item(' "a ""b"" c" ') == 'a "b" c'


def test_packed_table(spark, catalog):
    questions = spark.createDataFrame([("1", "A and B, Rev C", '["x_y"]'), ("1", "A and B, Rev C", '["x_y"]'), ("2", None, ""), (None, "A|B", "q_r,s_t")], "id string, source_product string, source_fields string")
    products = spark.createDataFrame([("B, Rev C", "k", "p")], "product_name string, product_kind string, platform string")
    rows = records(spark, [("A", "usage locations", "short, open or leaking line|x", None, 1), ("A", "usage_locations", '"short, open or leaking line"', None, 1)])
    got = {tuple(r) for r in split_packed(packed_texts(questions, rows, catalog), products).collect()}
    assert {g for g in got if g[0] == "source_product"} == {("source_product", "1", 1, "A"), ("source_product", "1", 2, "B, Rev C")}
    assert ("field_value", "r0", 1, "x") not in got
    empty = split_packed(packed_texts(questions.limit(0), rows.limit(0), catalog), products)
    assert empty.count() == 0


def test_names_beyond_the_bound_are_joined(spark, catalog, monkeypatch):
    import tessella.operators.packed as packed

    monkeypatch.setattr(packed, "NAMES", 0)
    questions = spark.createDataFrame([("1", "A and B, Rev C", None)], "id string, source_product string, source_fields string")
    products = spark.createDataFrame([("B, Rev C", "k", "p")], "product_name string, product_kind string, platform string")
    got = split_packed(packed_texts(questions, records(spark, [("A", "rated_power", "1 W", None, 1)]), catalog), products).collect()
    assert [r.item for r in sorted(got, key=lambda r: r.pos)] == ["A", "B, Rev C"]
