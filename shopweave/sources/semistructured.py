"""Products whose details are one VARIANT column, `data`: fields are read by path, so that stores may have what they like in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What the filters of operators.catalog read, where it stands in `data`, and as what.
FILTERED = {
    "product_type": ("$.product_type", "string"), "tags": ("$.tags", "array<string>"), "price_min": ("$.price_min", "bigint"), "price_max": ("$.price_max", "bigint"),
    "available": ("$.available", "boolean"), "title": ("$.title", "string"),
}


def to_data(products: DataFrame, keys: tuple[str, ...] = ("store_slug", "product_id", "handle")) -> DataFrame:
    """products as their keys and `data`, all other columns in it under their names; nulls are left out."""
    return products.select(*keys, F.parse_json(F.to_json(F.struct(*[c for c in products.columns if c not in keys]))).alias("data"))


def from_json_lines(lines: DataFrame, keys: tuple[str, ...] = ("store_slug", "product_id", "handle")) -> DataFrame:
    """The same of rows with one JSON object in `value` each; text that is no JSON gives null keys and data."""
    rows = lines.select(F.try_parse_json("value").alias("data"))
    return rows.select(*[field(F.col("data"), f"$.{k}").alias(k) for k in keys], "data")


def field(data: Column, path: str, kind: str = "string") -> Column:
    """What stands at a path, null where there is nothing or it doesn't fit the kind."""
    return F.try_variant_get(data, path, kind)


def variants_of(data: Column) -> Column:
    """The product's variants with what option filters read: options, of any names and scalar values, and whether it is available."""
    each = F.coalesce(field(data, "$.variants", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(each, lambda v: F.struct(field(v, "$.id").alias("id"), field(v, "$.options", "map<string,string>").alias("options"), field(v, "$.available", "boolean").alias("available")))


def filterable(rows: DataFrame) -> DataFrame:
    """rows with the columns that catalog.filter_products reads, taken from `data`; a filter that asks for one of them reads that path alone."""
    return rows.withColumns({**{c: field(F.col("data"), path, kind) for c, (path, kind) in FILTERED.items()}, "variants": variants_of(F.col("data"))})
