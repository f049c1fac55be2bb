"""Attribute-value rows into one typed row per entity.

`resolve_cells` gives every record its entity key, catalogued field and usable cell text; `latest_cells`
keeps one cell per entity and field, aggregating before any join; `widen` folds an entity's cells into a
map and projects the known fields into typed columns, with the texts that did not cast kept beside them.

Defined results: records without entity or of other fields count nowhere; placeholders are not usable
and give way to older usable values; a null time is the oldest; of equal times the greatest record_id
wins; rows delivered twice count once; entities without records stay, with null columns; an empty
record table gives entities with null columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.units import WORDS, field_lookup, normalise_units, squash
from tessella.session import small

# Texts that stand for a missing value.
PLACEHOLDERS = ["", "-", "--", "---", "—", "?", "??", "n/a", "na", "n.a.", "null", "none given", "nil", "nan", "tbd", "tba", "tbc", "unknown", "not stated", "not specified", "see drawing", "(blank)", "blank"]
# Wordings of a boolean.
TRUE = ["yes", "y", "true", "t", "1", "supported", "available", "included", "standard", "on"]
FALSE = ["no", "n", "false", "f", "0", "none", "not supported", "not available", "not included", "unsupported", "unavailable", "off"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
OLDEST = "0001-01-01 00:00:00"
TYPED = {"quantity": "bigint", "integer": "bigint", "boolean": "boolean", "date": "date", "text": "string"}


def entity_key(name: Column) -> Column:
    """A product name without marks, case, blanks and punctuation; null where nothing is left."""
    plain = F.regexp_replace(F.lower(F.translate(name, "   ", "   ")), r"[™®©]|\((?:r|tm|c)\)\s*$", "")
    return F.nullif(F.regexp_replace(plain, r"[^\p{L}\p{N}]", ""), F.lit(""))


def blanks(text: Column) -> Column:
    """Lower case, each run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s   -   　]+", " "))


def usable(text: Column) -> Column:
    return text.isNotNull() & ~text.isin(*PLACEHOLDERS)


def integer_cell(t: Column) -> Column:
    """Plain digits of the first number, written in digits (grouping commas, zero decimals) or as a word."""
    digits = F.regexp_replace(F.regexp_extract(t, r"(?<![\p{L}\d.,])(\d+(?:,\d{3})*(?:\.0+)?)(?![\d.,]*\d)", 1), r",|\.0+$", "")
    word = F.regexp_extract(t, r"(?:^|[^a-z])(" + "|".join(WORDS) + r")(?![a-z])", 1)
    words = F.create_map(*[x for w, n in WORDS.items() for x in (F.lit(w), F.lit(n))])
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.try_element_at(words, F.nullif(word, F.lit(""))).cast("bigint")).cast("string")


def boolean_cell(t: Column) -> Column:
    head = F.trim(F.regexp_replace(t, r"\(.*", ""))
    return F.when(head.isin(*TRUE), "true").when(head.isin(*FALSE), "false")


def date_cell(t: Column) -> Column:
    """YYYY-MM-DD of ISO dates and times, y/m/d, d.m.y, eight digits and dates with a month's name."""
    iso = F.regexp_extract(t, r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})(?:$|[t ])", 1)
    iso = F.regexp_replace(iso, "[/.]", "-")
    dmy = F.regexp_replace(F.regexp_extract(t, r"^(\d{1,2}[.]\d{1,2}[.]\d{4})$", 1), r"^(\d+)\.(\d+)\.(\d+)$", "$3-$2-$1")
    packed = F.regexp_replace(F.regexp_extract(t, r"^(\d{8})$", 1), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")
    named = F.lower(t)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(named, r"([a-z]{3})[a-z]*", 1)).cast("string")
    day = F.coalesce(F.nullif(F.regexp_extract(named, r"^(\d{1,2})(?:st|nd|rd|th)?\.? [a-z]", 1), F.lit("")), F.nullif(F.regexp_extract(named, r"^[a-z]+\.? (\d{1,2})(?:st|nd|rd|th)?,? \d{4}$", 1), F.lit("")))
    spelled = F.when(named.rlike(r"[a-z]{3,}") & (month != "0"), F.concat_ws("-", F.regexp_extract(named, r"(\d{4})$", 1), month, day))
    text = F.coalesce(*[F.nullif(x, F.lit("")) for x in (iso, dmy, packed)], spelled)
    return F.date_format(text.try_cast("date"), "yyyy-MM-dd")


def resolve_cells(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """(entity, field, at, record_id, cell, raw): one row per record of a catalogued single-valued field; cell is null where not usable."""
    plain = small(field_lookup(catalog, ("integer", "boolean", "date", "text")).select("key", F.col("field_name").alias("field"), "value_type"))
    rows = records.select("record_id", "extracted_at", entity_key(F.col("product_name")).alias("entity"), squash(F.col("field_name")).alias("key"), F.col("field_value").alias("raw")).where(F.col("entity").isNotNull())
    t = blanks(F.col("raw"))
    others = rows.join(plain, "key").select(
        "entity",
        "field",
        "extracted_at",
        "record_id",
        F.when(
            usable(t),
            F.when(F.col("value_type") == "integer", integer_cell(t)).when(F.col("value_type") == "boolean", boolean_cell(t)).when(F.col("value_type") == "date", date_cell(t)).otherwise(t),
        ).alias("cell"),
        F.when(usable(t), F.col("raw")).alias("raw"),
    )
    return others.withColumn("extracted_at", F.coalesce("extracted_at", F.lit(OLDEST).cast("timestamp_ntz")))


def quantity_cells(records: DataFrame, catalog: DataFrame, failures: bool = True) -> DataFrame:
    """The cells of quantity fields, from the unit operator; units that were only inferred are no cells. With failures, usable texts without cell are rows whose cell is null."""
    named = records.select("record_id", "field_name", "field_value", "evidence_text", "extracted_at", entity_key(F.col("product_name")).alias("entity")).where(F.col("entity").isNotNull())
    stated = normalise_units(named, catalog, ("entity", "extracted_at", "field_value")).where((F.col("bound") == "value") & (F.col("unit_source") != "inferred"))
    at = F.coalesce("extracted_at", F.lit(OLDEST).cast("timestamp_ntz")).alias("extracted_at")
    cells = stated.select("entity", "field", at, "record_id", F.col("common_milli").cast("string").alias("cell"), F.col("field_value").alias("raw"))
    if not failures:
        return cells
    fields = small(field_lookup(catalog, ("quantity",)).select("key", F.col("field_name").alias("field")))
    texts = named.select("entity", at, "record_id", squash(F.col("field_name")).alias("key"), F.col("field_value").alias("raw")).where(usable(blanks(F.col("raw")))).join(fields, "key").drop("key")
    a, b = texts.alias("a"), cells.where(F.col("cell").isNotNull()).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("entity", "field", "extracted_at", "record_id", "raw")]
    failed = a.join(b, same, "left_anti").select("entity", "field", "extracted_at", "record_id", F.lit(None).cast("string").alias("cell"), "raw")
    return cells.where(F.col("cell").isNotNull()).unionByName(failed)


def latest_cells(cells: DataFrame) -> DataFrame:
    """(entity, field, cell, failed, texts): the newest usable cell, the newest text that did not cast, and all such texts, each once. Partial aggregates come before the shuffle, so a hot entity costs one row per field and task."""
    order = F.struct("extracted_at", "record_id")
    return cells.groupBy("entity", "field").agg(
        F.max_by("cell", F.when(F.col("cell").isNotNull(), order)).alias("cell"),
        F.max_by("raw", F.when(F.col("cell").isNull() & F.col("raw").isNotNull(), order)).alias("failed"),
        F.array_sort(F.collect_set(F.when(F.col("cell").isNull(), F.col("raw")))).alias("texts"),
    )


def widen(records: DataFrame, products: DataFrame, catalog: DataFrame, failures: bool = True) -> DataFrame:
    """One row per product: product_name, one typed column per catalogued single-valued field, cast_failures (field -> newest text) and all_cast_failures (field -> all texts). Without failures, quantity fields are left out of these two.

    The field list is the catalogue's; it is read on the driver because it becomes the schema."""
    fields = catalog.where(F.col("value_type").isin(*TYPED)).select("field_name", "value_type").distinct().orderBy("field_name").collect()
    cells = latest_cells(resolve_cells(records, catalog).unionByName(quantity_cells(records, catalog, failures)))
    folded = cells.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("field", "cell")))).alias("cells"),
        F.map_from_entries(F.collect_list(F.when(F.col("failed").isNotNull(), F.struct("field", "failed")))).alias("cast_failures"),
        F.map_from_entries(F.collect_list(F.when(F.size("texts") > 0, F.struct("field", "texts")))).alias("all_cast_failures"),
    )
    names = products.select("product_name", entity_key(F.col("product_name")).alias("entity")).dropDuplicates(["product_name"])
    wide = names.join(folded, "entity", "left")
    return wide.select("product_name", *[F.try_element_at("cells", F.lit(f.field_name)).try_cast(TYPED[f.value_type]).alias(f.field_name) for f in fields], "cast_failures", "all_cast_failures")


def unpivot(wide: DataFrame) -> DataFrame:
    """(product_name, field_name, cell) of the filled cells of a wide table."""
    fields = [c for c in wide.columns if c not in ("product_name", "cast_failures", "all_cast_failures")]
    text = lambda c: F.date_format(c, "yyyy-MM-dd") if dict(wide.dtypes)[c] == "date" else F.col(c).cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("field_name"), text(c).alias("cell")) for c in fields])
    return wide.select("product_name", F.explode(F.filter(cells, lambda x: x["cell"].isNotNull())).alias("c")).select("product_name", "c.field_name", "c.cell")
