"""Between wide page rows and the long form (keys, dim, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: list[str], dims: list[str], name: str = "dim", value: str = "value") -> DataFrame:
    """One row for each row and non-null measure."""
    return df.select(*ids, *[F.col(d).cast("double") for d in dims]).unpivot(ids, dims, name, value).where(F.col(value).isNotNull())


def to_wide(long: DataFrame, ids: list[str], dims: list[str], name: str = "dim", value: str = "value") -> DataFrame:
    """Inverse of to_long; the dims are given, so no pass over the data looks for them."""
    return long.groupBy(*ids).pivot(name, dims).agg(F.first(value))


def flatten_groups(df: DataFrame, ids: list[str], groups: dict[str, list[str]], skip: tuple[str, ...] = ("status",)) -> DataFrame:
    """Nested structs to (ids, dim = group.key, value); skip names keys that are no measures."""
    cols = {f"{g}.{k}": F.col(f"{g}.{k}").cast("double") for g, keys in groups.items() for k in keys if k not in skip}
    pairs = F.array(*[F.struct(F.lit(n).alias("dim"), c.alias("value")) for n, c in cols.items()])
    return df.select(*ids, F.explode(pairs).alias("p")).select(*ids, "p.dim", "p.value").where("value is not null")


def missing_fields(df: DataFrame, ids: list[str], fields: list[str], placeholders: tuple[str, ...] = ("", "-", "n/a")) -> DataFrame:
    """(ids, field) of null or placeholder values."""
    texts = df.select(*ids, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])
    return texts.unpivot(ids, fields, "field", "value").where(F.lower("value").isin(*placeholders)).select(*ids, "field")
