"""Quantities recorded in different units: parse what is stated, infer what is not.

`normalise_units` turns attribute records into one row per record and bound with the value in the
catalogue's common unit. A stated unit (in the value, else in the field name, else in the evidence)
decides. Where none is stated, a log-scale mixture is fitted: the true values of a field form a
mixture of Gaussians on the log axis, and every unit shifts that mixture by its known factor; the
posterior over units assigns one, and a low posterior is flagged as uncertain. Units that differ by an
offset too (temperature) are fitted on the linear axis. Where little or nothing is stated of a field, the
posterior stays near the uniform prior, so that it is flagged.

Parsing is built from column expressions only. The mixture is fitted on a histogram per field, unit
and bin, whose size depends on the catalogue and the bin width, never on the number of records.

Defined results: a null or blank value, a placeholder, a value without number and a unit of another
quantity give no row; rows delivered twice give one row; an empty table gives no row; extra columns
are ignored; the text may be of any length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import keep, small

PSI = 6894.757293168
CFM = 60 * 0.3048**3
# Unit spellings (lower case) with factor and offset to the common unit of the quantity.
UNITS: dict[str, dict[str, tuple[float, float]]] = {
    "power": {**dict.fromkeys(["w", "watt", "watts"], (1.0, 0.0)), **dict.fromkeys(["mw", "milliwatt", "milliwatts"], (0.001, 0.0)), **dict.fromkeys(["kw", "kilowatt", "kilowatts"], (1000.0, 0.0))},
    "voltage": {
        **dict.fromkeys(["v", "volt", "volts", "vrms", "vdc", "vac", "v dc", "v ac"], (1.0, 0.0)),
        **dict.fromkeys(["mv", "millivolt", "millivolts"], (0.001, 0.0)),
        **dict.fromkeys(["kv", "kilovolt", "kilovolts"], (1000.0, 0.0)),
    },
    "current": {
        **dict.fromkeys(["ma", "ma dc", "milliamp", "milliamps", "milliampere", "milliamperes"], (1.0, 0.0)),
        **dict.fromkeys(["a", "amp", "amps", "ampere", "amperes"], (1000.0, 0.0)),
        **dict.fromkeys(["ua", "µa", "microamp", "microamps", "microampere", "microamperes"], (0.001, 0.0)),
    },
    "resistance": {**dict.fromkeys(["ω", "ohm", "ohms"], (1.0, 0.0)), **dict.fromkeys(["kω", "kohm", "kohms", "kilohm", "kilohms"], (1000.0, 0.0))},
    "mass": {
        **dict.fromkeys(["g", "gram", "grams"], (1.0, 0.0)),
        **dict.fromkeys(["kg", "kilogram", "kilograms"], (1000.0, 0.0)),
        **dict.fromkeys(["lb", "lbs", "lb.", "lbs.", "pound", "pounds"], (453.59237, 0.0)),
        **dict.fromkeys(["oz", "oz.", "ounce", "ounces"], (453.59237 / 16, 0.0)),
    },
    "distance": {
        **dict.fromkeys(["m", "meter", "meters", "metre", "metres"], (1.0, 0.0)),
        **dict.fromkeys(["km", "kilometer", "kilometers", "kilometre", "kilometres"], (1000.0, 0.0)),
        **dict.fromkeys(["ft", "ft.", "foot", "feet"], (0.3048, 0.0)),
        **dict.fromkeys(["yd", "yd.", "yard", "yards"], (0.9144, 0.0)),
    },
    "size": {
        **dict.fromkeys(["mm", "millimeter", "millimeters", "millimetre", "millimetres"], (1.0, 0.0)),
        **dict.fromkeys(["cm", "centimeter", "centimeters", "centimetre", "centimetres"], (10.0, 0.0)),
        **dict.fromkeys(["in", "in.", '"', "inch", "inches"], (25.4, 0.0)),
    },
    "charge": {**dict.fromkeys(["ah", "amp-hour", "amp-hours"], (1.0, 0.0)), **dict.fromkeys(["mah", "milliamp-hours"], (0.001, 0.0))},
    "frequency": {**dict.fromkeys(["hz", "hertz"], (1.0, 0.0)), **dict.fromkeys(["khz", "kilohertz"], (1000.0, 0.0))},
    "angle": {**dict.fromkeys(["°", "deg", "degree", "degrees"], (1.0, 0.0)), **dict.fromkeys(["rad", "radian", "radians"], (180 / math.pi, 0.0))},
    "time": {
        **dict.fromkeys(["ms", "msec", "millisecond", "milliseconds"], (1.0, 0.0)),
        **dict.fromkeys(["s", "sec", "secs", "second", "seconds"], (1000.0, 0.0)),
        **dict.fromkeys(["min", "minute", "minutes"], (60000.0, 0.0)),
    },
    "flow": {
        **dict.fromkeys(["m³/h", "m3/h", "cu m/h"], (1.0, 0.0)),
        **dict.fromkeys(["l/s", "litres per second", "liters per second"], (3.6, 0.0)),
        **dict.fromkeys(["cfm", "ft³/min", "ft3/min"], (CFM, 0.0)),
    },
    "pressure": {
        **dict.fromkeys(["pa", "pascal", "pascals"], (1.0, 0.0)),
        **dict.fromkeys(["kpa", "kilopascal", "kilopascals"], (1000.0, 0.0)),
        **dict.fromkeys(["hpa", "mbar", "millibar", "millibars"], (100.0, 0.0)),
        **dict.fromkeys(["psi", "lbf/in²", "lbf/in2"], (PSI, 0.0)),
    },
    "temperature": {
        **dict.fromkeys(["c", "°c", "deg c", "degc", "degree celsius", "degrees celsius", "celsius"], (1.0, 0.0)),
        **dict.fromkeys(["k", "kelvin", "kelvins"], (1.0, -273.15)),
        **dict.fromkeys(["f", "°f", "deg f", "degf", "degree fahrenheit", "degrees fahrenheit", "fahrenheit"], (5 / 9, -160 / 9)),
    },
}
# Numbers written as words.
WORDS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty hundred".split(), [*range(21), 30, 40, 50, 60, 100]))

_quote = lambda u: "".join("\\" + c if c in '.^$*+?()[]{}|\\/"' else c for c in u)
ANY_UNIT = "|".join(_quote(u) for u in sorted({u for q in UNITS.values() for u in q}, key=lambda u: (-len(u), u)))
NUMBER = r"\d+ \d+/\d+|\d+/\d+|\d+(?:[.,]\d+)*|(?:" + "|".join(WORDS) + r")(?![a-z])"
#: A number that does not continue a word or another number, and the unit right after it, if any.
VALUE = rf'(?<![a-z0-9.,/])({NUMBER})(?: ?({ANY_UNIT})(?![a-z0-9³²]))?'
SIGNED = rf'((?:(?<![a-z0-9°"ω.)])-)?(?<![a-z0-9.,/])(?:{NUMBER}))(?: ?({ANY_UNIT})(?![a-z0-9³²]))?'
BEFORE = rf"(?:^|[^a-z0-9])({ANY_UNIT})[\])]?:? ?$"

BIN = 0.02  # width of a histogram bin on the log10 axis
DEGREES = 0.5  # width of a histogram bin on the linear axis
BACKGROUND = 0.01  # weight of the wide Gaussian
PRIOR = 10.0  # stated values that weigh as much as the uniform prior of the units
MIN_POSTERIOR = 0.9  # under it an inferred unit is flagged as uncertain


def clean(text: Column) -> Column:
    """Lower case, plain blanks, minus signs and quote marks, outer blanks off."""
    t = F.lower(F.translate(text, "   −–—‑‐μ″”", "   -----µ\"\""))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def number(text: Column) -> Column:
    """The double of a number text: digits with grouping commas (before exactly three digits) or a decimal comma, fractions, words."""
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    t = F.regexp_replace(text, "^-", "")
    plain = F.regexp_replace(F.regexp_replace(t, r",(?=\d{3}(?!\d))", ""), ",", ".").try_cast("double")
    whole = F.coalesce(F.regexp_extract(t, r"^(\d+) \d", 1).try_cast("double"), F.lit(0.0))
    part = F.try_divide(F.regexp_extract(t, r"(\d+)/\d+$", 1).try_cast("double"), F.regexp_extract(t, r"/(\d+)$", 1).try_cast("double"))
    words = F.create_map(*[x for w, n in WORDS.items() for x in (F.lit(w), F.lit(float(n)))])
    return sign * F.when(t.contains("/"), whole + part).when(t.rlike("^[a-z]"), F.try_element_at(words, t)).otherwise(plain)


def milli(value: Column) -> Column:
    """Thousandths, rounded to the nearest integer; the inner rounding removes the noise of binary fractions."""
    return F.round(F.round(value * 1000, 6)).cast("bigint")


def squash(name: Column) -> Column:
    """A field name reduced to lower-case letters and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9µ]", "")


def field_lookup(catalog: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(key, field_name, value_type, quantity, name_unit): every squashed spelling of a catalogued field, with and without a unit behind it.

    Its rows are the catalogue's rows times the spellings of UNITS, so its size is bounded by the catalogue."""
    spark = catalog.sparkSession
    ends = [(q, "", None) for q in UNITS] + list({(q, p + "".join(c for c in u if c.isascii() and c.isalnum() or c == "µ"), u): 0 for q, us in UNITS.items() for u in us for p in ("", "in") if any(c.isalnum() and c != "ω" and c != "°" for c in u)})
    known = spark.createDataFrame(ends, "quantity string, suffix string, name_unit string")
    fields = catalog.where(F.col("field_name").isNotNull()).select("field_name", "value_type", "quantity")
    if types:
        fields = fields.where(F.col("value_type").isin(*types))
    full = fields.join(F.broadcast(known), "quantity").unionByName(fields.where(F.col("quantity").isNull()).withColumns({"suffix": F.lit(""), "name_unit": F.lit(None).cast("string")}))
    keyed = full.withColumn("key", F.concat(squash(F.col("field_name")), F.col("suffix")))
    # A key that two fields or two units could mean keeps the shorter suffix, so the longer field name wins.
    return keyed.groupBy("key").agg(*[F.min_by(c, F.struct(F.length("suffix"), "field_name", "name_unit")).alias(c) for c in ("field_name", "value_type", "quantity", "name_unit")])


def _factors() -> tuple[Column, Column]:
    pairs = [(f"{q}\t{u}", f, o) for q, us in UNITS.items() for u, (f, o) in us.items()]
    return tuple(F.create_map(*[x for p in pairs for x in (F.lit(p[0]), F.lit(float(p[i])))]) for i in (1, 2))


def parse_quantities(records: DataFrame, catalog: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(record_id, field, quantity, bound, raw, unit, unit_source, milli) of every quantity record with a number, and the columns to carry along.

    unit_source is value, field_name, evidence or null (no unit anywhere). Units of another quantity leave no row."""
    lookup = small(field_lookup(catalog, ("quantity", "quantity_range")))
    base = (
        records.select("record_id", *carry, squash(F.col("field_name")).alias("key"), clean(F.col("field_value")).alias("v"), F.col("evidence_text").alias("e"))
        .where(F.col("v").rlike("[0-9]") | F.col("v").rlike("(?:^|[^a-z])(?:" + "|".join(WORDS) + ")[^a-z]"))
        .join(lookup, "key")
        .withColumn("ranged", F.col("value_type") == "quantity_range")
    )
    found = lambda group: F.when(F.col("ranged"), F.regexp_extract_all("v", F.lit(SIGNED), F.lit(group))).otherwise(F.regexp_extract_all("v", F.lit(VALUE), F.lit(group)))
    numbers = base.withColumns({"ns": found(1), "us": found(2)})
    at = lambda c, i: F.nullif(F.get(F.col(c), F.lit(i)), F.lit(""))
    numbers = numbers.withColumns({"n1": at("ns", 0), "n2": at("ns", 1), "u1": at("us", 0), "u2": at("us", 1)})
    numbers = numbers.where(F.col("n1").isNotNull() & (~F.col("ranged") | F.col("n2").isNotNull()))
    lead = F.call_function("substring_index", F.col("v"), F.col("n1"), F.lit(1))
    before = F.when(F.col("u1").isNull(), F.nullif(F.regexp_extract(lead, BEFORE, 1), F.lit("")))
    after = F.when(F.col("ranged"), F.coalesce("u1", "u2")).otherwise(F.col("u1"))
    # The evidence repeats the value and may add the unit; it is read only where value and name have none.
    tail = F.call_function("substring_index", clean(F.col("e")), F.col("n1"), F.lit(-1))
    shown = F.when(clean(F.col("e")).contains(F.col("n1")), F.nullif(F.regexp_extract(tail, rf"^ ?({ANY_UNIT})(?![a-z0-9³²])", 1), F.lit("")))
    stated = numbers.withColumn("vu", F.coalesce(after, before)).withColumn("eu", F.when(F.col("vu").isNull() & F.col("name_unit").isNull(), shown))
    stated = stated.withColumns(
        {
            "unit_source": F.when(F.col("vu").isNotNull(), "value").when(F.col("name_unit").isNotNull(), "field_name").when(F.col("eu").isNotNull(), "evidence"),
            "unit": F.coalesce("vu", "name_unit", "eu"),
        }
    )
    low = F.struct(F.when(F.col("ranged"), "low").otherwise("value").alias("bound"), number(F.col("n1")).alias("raw"), F.when(F.col("ranged"), F.coalesce("u1", "unit")).otherwise(F.col("unit")).alias("unit"))
    high = F.when(F.col("ranged"), F.struct(F.lit("high").alias("bound"), number(F.col("n2")).alias("raw"), F.coalesce("u2", "unit").alias("unit")))
    rows = stated.select("record_id", *carry, F.col("field_name").alias("field"), "quantity", "unit_source", F.explode(F.filter(F.array(low, high), lambda x: x.isNotNull())).alias("b"))
    factors, offsets = _factors()
    key = F.concat_ws("\t", "quantity", "b.unit")
    value = F.col("b.raw") * F.try_element_at(factors, key) + F.try_element_at(offsets, key)
    rows = rows.select("record_id", *carry, "field", "quantity", "b.bound", "b.raw", "b.unit", "unit_source", milli(value).alias("milli"))
    return rows.where(F.col("raw").isNotNull() & (F.col("unit").isNull() | F.col("milli").isNotNull()))


@dataclass
class Mixture:
    """A fitted mixture of one field on the axis of its common unit: Gaussians of the true value, shared by all units, a wide background, and a share for each unit."""

    means: np.ndarray
    sds: np.ndarray
    weights: np.ndarray
    shares: np.ndarray
    evidence: float  # share of trust in the fit against a uniform prior, by how much is stated

    def posterior(self, places: np.ndarray, jacobian: np.ndarray) -> np.ndarray:
        """P(unit | number), one row for each number; places are the number's values in the common unit under each unit."""
        p = _density(places, jacobian, self.means, self.sds, self.weights).sum(2) * self.shares + 1e-300
        return self.evidence * p / p.sum(1, keepdims=True) + (1 - self.evidence) / places.shape[1]


def _density(places: np.ndarray, jacobian: np.ndarray, means: np.ndarray, sds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted densities (number, unit, Gaussian) of the raw number; the jacobian is that of the unit's conversion on this axis."""
    return np.exp(-0.5 * ((places[:, :, None] - means) / sds) ** 2) / sds * weights * jacobian[None, :, None]


def fit_mixture(places: np.ndarray, jacobian: np.ndarray, counts: np.ndarray, known: np.ndarray, narrow: float, wide: float, parts: int = 24, rounds: int = 60) -> Mixture:
    """EM over a weighted histogram. places: (number, unit) values in the common unit; known: index of the stated unit or -1, where the unit is latent.

    The Gaussians begin at the quantiles of the stated values, so that each begins where data are; narrow is their first
    deviation, wide that of the fixed background, which keeps numbers far from all data undecided. Without stated units
    the numbers cannot tell a unit: the evidence is 0 and every posterior stays at the prior."""
    have = known >= 0
    stated, n_units = float(counts[have].sum()), places.shape[1]
    if not stated:
        return Mixture(np.zeros(1), np.full(1, wide), np.ones(1), np.full(n_units, 1 / n_units), 0.0)
    common, weight = places[have, known[have]], counts[have]
    order = np.argsort(common)
    cum = np.cumsum(weight[order]) / weight.sum()
    means = np.unique(np.round(common[order][np.clip(np.searchsorted(cum, (np.arange(parts) + 0.5) / parts), 0, len(order) - 1)] / narrow) * narrow)
    means = np.append(means, np.average(common, weights=weight))
    k = len(means)
    sds = np.append(np.full(k - 1, narrow), wide)
    weights = np.append(np.full(k - 1, (1 - BACKGROUND) / (k - 1)), BACKGROUND)
    shares = np.bincount(known[have], counts[have], n_units) + 1.0
    shares /= shares.sum()
    allowed = np.where(known[:, None] < 0, 1.0, (np.arange(n_units)[None, :] == known[:, None]).astype(float))
    for _ in range(rounds):
        dens = _density(places, jacobian, means, sds, weights) * (shares * allowed)[:, :, None] + 1e-300
        resp = dens / dens.sum((1, 2), keepdims=True) * counts[:, None, None]
        per = resp.sum((0, 1))[:-1] + 1e-9
        means[:-1] = (resp * places[:, :, None]).sum((0, 1))[:-1] / per
        sds[:-1] = np.sqrt((resp * (places[:, :, None] - means) ** 2).sum((0, 1))[:-1] / per + (narrow / 5) ** 2)
        weights[:-1] = (1 - BACKGROUND) * (per + 1e-3) / (per + 1e-3).sum()
        latent = resp[known < 0].sum((0, 2))
        # Shares of the records without unit, held by a weak prior at the shares of those with one.
        new = latent + 5.0 * np.maximum(shares, 1e-3)
        shares = new / new.sum()
    return Mixture(means, sds, weights, shares, stated / (stated + PRIOR))


def unit_classes(quantity: str) -> list[tuple[str, float, float]]:
    """(first spelling, factor, offset) of each distinct conversion."""
    seen: dict[tuple[float, float], str] = {}
    for u, fo in UNITS[quantity].items():
        seen.setdefault(fo, u)
    return [(u, f, o) for (f, o), u in seen.items()]


def on_axis(quantity: str, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(places, jacobian, narrow, wide) of raw numbers: the log axis, on which units are known offsets; for units with an offset of their own, as those of temperature, the linear axis."""
    classes = unit_classes(quantity)
    factors, offsets = np.array([f for _, f, _ in classes]), np.array([o for _, _, o in classes])
    if offsets.any():
        return raw[:, None] * factors + offsets, factors, 3.0, 300.0
    return np.log10(np.abs(raw))[:, None] + np.log10(factors), np.ones(len(classes)), 0.05, 2.0


def binned(raw: Column, quantity: Column) -> Column:
    """The histogram bin of a raw number: of width BIN on the log axis, of DEGREES for units with an offset; null for 0 on the log axis."""
    linear = quantity.isin(*[q for q, us in UNITS.items() if any(o for _, o in us.values())])
    return F.when(linear, F.floor(raw / DEGREES)).when(raw != 0, F.floor(F.log10(F.abs(raw)) / BIN))


def infer_missing(parsed: DataFrame) -> DataFrame:
    """(field, bin, unit, factor, offset, posterior): for each field and bin of numbers without unit, the most likely unit.

    The histogram that is collected holds at most fields x unit classes x bins rows."""
    factors, offsets = _factors()
    key = F.concat_ws("\t", "quantity", "unit")
    cells = parsed.select("field", "quantity", F.try_element_at(factors, key).alias("factor"), F.try_element_at(offsets, key).alias("offset"), binned(F.col("raw"), F.col("quantity")).alias("bin"))
    hist = cells.where("bin is not null").groupBy("field", "quantity", "factor", "offset", "bin").count().toPandas()
    out = []
    for (field, quantity), part in hist.groupby(["field", "quantity"]):
        classes = unit_classes(quantity)
        index = {(f, o): i for i, (_, f, o) in enumerate(classes)}
        known = np.array([index.get((f, o), -1) if f == f else -1 for f, o in zip(part["factor"], part["offset"])])
        if not (known < 0).any():
            continue
        linear = any(o for _, _, o in classes)
        middle = lambda b, linear=linear: (b + 0.5) * DEGREES if linear else 10 ** ((b + 0.5) * BIN)
        places, jacobian, narrow, wide = on_axis(quantity, middle(part["bin"].to_numpy(float)))
        model = fit_mixture(places, jacobian, part["count"].to_numpy(float), known, narrow, wide)
        bins = np.unique(part["bin"].to_numpy()[known < 0])
        post = model.posterior(on_axis(quantity, middle(bins.astype(float)))[0], jacobian)
        out += [(field, int(b), *classes[i], float(p[i])) for b, p in zip(bins, post) for i in [int(p.argmax())]]
    return parsed.sparkSession.createDataFrame(out, "field string, bin bigint, inferred_unit string, factor double, offset double, posterior double")


def normalise_units(records: DataFrame, catalog: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per record and bound: (record_id, bound, field, quantity, unit, unit_source, posterior, uncertain, common_milli).

    Columns named in carry stay beside them. Stated units have posterior 1; inferred ones carry the mixture's posterior and are uncertain under MIN_POSTERIOR."""
    return with_units(keep(parse_quantities(records, catalog, carry)), carry)


def with_units(parsed: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """`normalise_units` of parsed quantities. A number 0 without unit is 0 in every unit of a quantity without offsets: certain, though its unit stays null."""
    guess = small(infer_missing(parsed))
    rows = parsed.withColumn("bin", F.when(F.col("unit").isNull(), binned(F.col("raw"), F.col("quantity")))).join(guess, ["field", "bin"], "left")
    inferred = F.col("unit").isNull() & F.col("inferred_unit").isNotNull()
    zero = F.col("unit").isNull() & F.col("bin").isNull()
    return rows.select(
        "record_id",
        *carry,
        "bound",
        "field",
        "quantity",
        F.coalesce("unit", "inferred_unit").alias("unit"),
        F.when(inferred | zero, "inferred").otherwise(F.col("unit_source")).alias("unit_source"),
        F.when(inferred, F.round("posterior", 4)).when(F.col("unit").isNotNull() | zero, F.lit(1.0)).alias("posterior"),
        F.when(F.col("unit").isNotNull() | zero, F.lit(False)).otherwise(F.coalesce(F.col("posterior") < MIN_POSTERIOR, F.lit(True))).alias("uncertain"),
        F.when(zero, F.lit(0).cast("bigint")).otherwise(F.coalesce("milli", milli(F.col("raw") * F.col("factor") + F.col("offset")))).alias("common_milli"),
    ).distinct()
