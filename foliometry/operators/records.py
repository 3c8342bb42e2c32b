"""Requests of actions checked against a table of their parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a rule table: one row an action and parameter, or a row with a null parameter for an action that takes none.
RULES = "action string, param string, type string, required boolean, default string, lo double, hi double, pattern string, longest int"


def _checked(s: Column, value: Column) -> Column:
    """(clean, error) of a value that is given; clean is null where there is an error."""
    text, kind = F.trim(value), s["type"]
    form = F.when(kind == "int", "^[+-]?[0-9]+$").otherwise(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    number = F.when(F.regexp(text, form), text.try_cast("double"))
    numeric = kind.isin("int", "float")
    error = (
        F.when(numeric & number.isNull(), F.concat(F.lit("needs "), kind))
        .when(numeric & (number < s["lo"]), "below range")
        .when(numeric & (number > s["hi"]), "above range")
        .when((kind == "bool") & ~F.lower(text).isin("true", "false"), "needs bool")
        .when((kind == "text") & (F.char_length(value) > s["longest"]), "too long")
        .when((kind == "text") & s["pattern"].isNotNull() & ~F.regexp(text, s["pattern"]), "bad format")
    )
    clean = F.when(kind == "bool", F.lower(text)).otherwise(text)
    return F.struct(F.when(error.isNull(), clean).alias("clean"), error.alias("error"))


def validated(records: DataFrame, rules: DataFrame) -> DataFrame:
    """records (action, params: map of texts, and other columns) with ok, clean and errors.

    An action that the rules lack is an error, as are parameters that they lack, required ones that are missing or null, and
    values of a wrong type, out of range, too long or of another format. clean holds checked values and defaults of missing
    ones; errors are sorted. A null action is unknown; null params are none. The rules of an action meet in one row: their
    table is small, records are neither exploded nor grouped.
    """
    spec = rules.groupBy(F.col("action").alias("__action")).agg(F.collect_list(F.when(F.col("param").isNotNull(), F.struct(*[c.split()[0] for c in RULES.split(", ")][1:]))).alias("__spec"))
    given = F.coalesce("params", F.create_map().cast("map<string, string>"))
    value = lambda s: F.element_at(given, s["param"])

    def one(s: Column) -> Column:
        v = value(s)
        absent = F.struct(s["default"].alias("clean"), F.when(s["required"], "missing").alias("error"))
        return F.struct(s["param"].alias("param"), F.when(v.isNull(), absent).otherwise(_checked(s, v)).alias("r"))

    j = records.join(spec, F.col("action") == F.col("__action"), "left")
    rows = j.withColumn("__found", F.transform("__spec", one))
    odd = F.array_except(F.map_keys(given), F.transform("__spec", lambda s: s["param"]))
    errors = F.concat(F.transform(odd, lambda k: F.concat(k, F.lit(": unknown"))), F.transform(F.filter("__found", lambda x: x["r"]["error"].isNotNull()), lambda x: F.concat_ws(": ", x["param"], x["r"]["error"])))
    rows = rows.withColumn("errors", F.when(F.col("__action").isNull(), F.array(F.lit("unknown action"))).otherwise(F.array_sort(errors)))
    kept = F.filter("__found", lambda x: x["r"]["clean"].isNotNull())
    clean = F.map_from_arrays(F.transform(kept, lambda x: x["param"]), F.transform(kept, lambda x: x["r"]["clean"]))
    return rows.select(*records.columns, (F.size("errors") == 0).alias("ok"), F.coalesce(clean, F.create_map().cast("map<string, string>")).alias("clean"), "errors")
