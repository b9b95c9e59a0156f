"""Options and properties of no fixed shape, as VARIANT: typed when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def properties(text: Column) -> Column:
    """JSON text as VARIANT; null for null and for what is no JSON."""
    return F.try_parse_json(text)


def typed(value: Column, path: str, kind: str) -> Column:
    """What stands at a path (``$.a.b[0]``) as a type; null if nothing does, or something that can't become that type."""
    return F.try_variant_get(value, path, kind)


def shape(rows: DataFrame, value: str) -> DataFrame:
    """(shape): one schema that all values of a VARIANT column have, fields merged by name; clashing types become VARIANT."""
    return rows.agg(F.schema_of_variant_agg(value).alias("shape"))


def merged_options(defaults: Column, given: Column) -> Column:
    """A map of VARIANT options by name: the given ones, and the defaults of those not given. Both are VARIANT objects."""
    as_map = lambda v: F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    left = F.map_filter(as_map(defaults), lambda k, _: ~F.map_contains_key(as_map(given), k))
    return F.map_concat(left, as_map(given))
