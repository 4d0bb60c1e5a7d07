"""Search conditions: dictionary keys to a site's properties, addresses, descriptions and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which options stand for a quality.
QUALITIES = {"rare": ("rare",), "magic": ("magic",), "normal": ("normal", "superior")}


def property_labels(name: Column) -> Column:
    """A property's label: each ``{{x}}`` of its name is an X."""
    return F.regexp_replace(name, r"\{\{[^}]*\}\}", "X")


def normal_properties(json: Column) -> Column:
    """The usable rows of a property list as an array of ``id, name, type, label, required``: an integer id, and a name and type of text."""
    rows = F.from_json(json, "array<struct<id: string, name: string, type: string, required: boolean, format: struct<syncOnly: boolean>>>")
    good = F.filter(rows, lambda r: F.rlike(r["id"], F.lit("^-?[0-9]+$")) & r["name"].isNotNull() & r["type"].isNotNull())
    asked = lambda r: F.coalesce(r["required"], F.lit(False)) & ~F.coalesce(r["format"]["syncOnly"], F.lit(False))
    return F.transform(good, lambda r: F.struct(r["id"].cast("int").alias("id"), r["name"].alias("name"), r["type"].alias("type"), property_labels(r["name"]).alias("label"), asked(r).alias("required")))


def map_properties(entries: DataFrame, properties: DataFrame) -> DataFrame:
    """Adds ``property_id`` and ``property`` to dictionary entries (``key, kind, pattern``): the one property of the right type whose label the pattern
    finds, null where there is none or several.

    Entries are a dictionary of tens of rows, which are met with every property; matches are counted map-side.
    """
    typed = properties.select(F.col("id").alias("property_id"), F.col("name").alias("property"), "type", "label")
    met = typed.join(entries.select("key", "kind", "pattern"), F.col("type") == F.when(F.col("kind") == "bool", "bool").otherwise("number")).where("label rlike pattern")
    one = met.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("property_id", "property")).alias("p")).where("n = 1")
    return entries.join(one.select("key", "p.property_id", "p.property"), "key", "left")


def unmapped_keys(mapped: DataFrame) -> DataFrame:
    return mapped.where("property_id is null").select("key")


def active_conditions(conditions: DataFrame, mapped: DataFrame) -> DataFrame:
    """Switched-on conditions with their property, and ``use``: ``filter``, ``no value`` (a number without limits is no filter) or ``unmapped``."""
    on = conditions.where("on").join(mapped.select("key", "kind", "property_id", "property"), "key", "left")
    bare = (F.col("kind") != "bool") & F.col("min").isNull() & F.col("max").isNull()
    return on.withColumn("use", F.when(F.col("property_id").isNull(), "unmapped").when(bare, "no value").otherwise("filter"))


def url_part(text: Column) -> Column:
    """Percent-encoded, a space as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def condition_params(kind: Column, property_id: Column, name: Column, least: Column, most: Column) -> Column:
    """The address parameters of one condition, as an array."""
    flag = F.array(F.concat(F.lit("prop_"), url_part(name), F.lit("=true")))
    limit = lambda v, tag: F.when(v.isNotNull(), F.concat(F.lit("prop_"), property_id.cast("string"), F.lit(f"{tag}="), v.cast("string")))
    numbers = F.filter(F.array(limit(least, "Min"), limit(most, "Max")), lambda x: x.isNotNull())
    return F.when(kind == "bool", flag).otherwise(numbers)


def describe_condition(kind: Column, label: Column, least: Column, most: Column) -> Column:
    """A condition in words; null for a number without limits."""
    return (
        F.when(kind == "bool", label).when(least.isNotNull() & most.isNotNull(), F.concat(label, F.lit(" "), least.cast("string"), F.lit("–"), most.cast("string")))
        .when(most.isNotNull(), F.concat(label, F.lit(" ≤"), most.cast("string"))).when(least.isNotNull(), F.concat(label, F.lit(" ≥"), least.cast("string")))
    )


def quality_value(quality: Column, options: Column) -> Column:
    """The comma list of a quality's options; null unless the property has all of them."""
    out = F.lit(None).cast("string")
    for name, values in QUALITIES.items():
        usable = F.size(F.array_except(F.array(*[F.lit(v) for v in values]), options)) == 0
        out = F.when(quality == name, F.when(usable, ",".join(values))).otherwise(out)
    return out


def type_for_base(base: Column, types: Column) -> Column:
    """The first listed type that is the base's word, without regard to case."""
    wanted = F.lower(F.trim(F.coalesce(base, F.lit(""))))
    return F.when(wanted != "", F.try_element_at(F.filter(types, lambda t: F.lower(t) == wanted), F.lit(1)))


def query_pairs(url: Column) -> Column:
    """The ``key=value`` texts of an address's query string, decoded."""
    parts = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.try_url_decode(F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))


def keeps_params(final: Column, expected: Column) -> Column:
    """Whether an address still has every parameter of the one that was opened."""
    return F.coalesce(F.size(F.array_except(query_pairs(expected), query_pairs(final))) == 0, F.lit(False))


def stats_checks(is_home: Column, url_kept: Column, labels: Column, text: Column, missing: Column, status: Column) -> dict[str, Column]:
    """The six checks of a condition search, by name, for ``market.checks_summary``."""
    return {
        "home_page": is_home, "filters_in_url": url_kept, "filters_shown": F.forall(labels, lambda x: F.contains(F.coalesce(text, F.lit("")), x)),
        "rows_match_filters": F.when(status == "PASSED", missing == 0).otherwise(F.lit(True)), "trading_rows_ok": status == "PASSED", "not_blocked": status != "BLOCKED",
    }
