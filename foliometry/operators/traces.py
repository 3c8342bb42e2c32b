"""Ordered folds over the versions of a document: each is judged against the last one that was accepted.

A document's trace is one bounded array (the trials of one run); the fold keeps the accepted version as its state.

Defined results: versions are taken in order of seq, equal ones by version; the first one is the base and counts as accepted;
null scores never win; a document without versions has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: scores closer than this are equal.
EQUAL = 1e-9


def verdict(new: Column, held: Column) -> Column:
    """Why a version is accepted (the reason begins with +) or not, by rules in order: gates, pages while both are too long, m1, m2.

    Both have n_gate (broken rules), long (whether too many pages is one), pages, scored, m1 and m2.
    """
    lower, higher = lambda c: new[c] < held[c] - EQUAL, lambda c: new[c] > held[c] + EQUAL
    no_more = new["pages"].isNotNull() & (new["pages"] <= F.coalesce(held["pages"], F.lit(1 << 30)))
    compress = (new["n_gate"] > 0) & new["long"] & held["long"]
    return (
        F.when(new["n_gate"] < held["n_gate"], "+fewer broken rules").when(new["n_gate"] > held["n_gate"], "more broken rules")
        .when(compress & no_more, "+compression, no more pages").when(compress, "compression, more pages").when(~new["scored"] | (new["n_gate"] > 0), "not scored").when(new["m1"].isNull() | held["m1"].isNull(), "m1 missing")
        .when(lower("m1"), "+lower m1").when(higher("m1"), "higher m1").when(lower("m2"), "+lower m2").otherwise("no gain")
    )


def judged(versions: DataFrame) -> DataFrame:
    """(doc, seq, version, n_gate, long, pages, scored, m1, m2) to doc, seq, version, base (the version it was held against), accepted, reason."""
    fields = ["seq", "version", "n_gate", "long", "pages", "scored", "m1", "m2"]
    traces = versions.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("trace"))
    step = "struct<seq:bigint,version:bigint,base:bigint,accepted:boolean,reason:string>"

    def fold(state: Column, new: Column) -> Column:
        held = state["held"]
        why = F.coalesce(verdict(new, held), F.lit("no gain"))
        taken = why.startswith("+")
        row = F.struct(new["seq"].cast("bigint").alias("seq"), new["version"].cast("bigint").alias("version"), held["version"].cast("bigint").alias("base"), taken.alias("accepted"), F.regexp_replace(why, r"^\+", "").alias("reason"))
        return F.struct(F.when(taken, new).otherwise(held).alias("held"), F.concat(state["steps"], F.array(row)).alias("steps"))

    first = F.get("trace", F.lit(0))
    base = F.struct(first["seq"].cast("bigint").alias("seq"), first["version"].cast("bigint").alias("version"), F.lit(None).cast("bigint").alias("base"), F.lit(True).alias("accepted"), F.lit("first").alias("reason"))
    start = F.struct(first.alias("held"), F.array(base).cast(f"array<{step}>").alias("steps"))
    steps = F.aggregate(F.slice("trace", 2, F.greatest(F.size("trace") - 1, F.lit(0))), start, fold, lambda s: s["steps"])
    return traces.select("doc", F.explode(steps).alias("s")).select("doc", "s.*")


def final_status(versions: DataFrame, most_m2: float | None = None) -> DataFrame:
    """The state that each document's run ends in: doc, status, attempts, accepted, version. versions also has defects (high ones)."""
    steps = judged(versions)
    run = steps.groupBy("doc").agg(
        (F.count("*") - 1).alias("attempts"), (F.count_if("accepted") - 1).alias("accepted"), F.max(F.when(F.col("accepted"), F.struct("seq", "version"))).alias("last"),
    )
    end = run.select("doc", "attempts", "accepted", F.col("last.version").alias("version"), F.col("last.seq").alias("seq"))
    now = end.join(versions.select("doc", "seq", "version", "n_gate", "defects", "m2"), ["doc", "seq", "version"])
    over = F.coalesce(F.col("m2") > most_m2, F.lit(False)) if most_m2 is not None else F.lit(False)
    status = (
        F.when((F.col("n_gate") > 0) & (F.col("attempts") > 0), "EXHAUSTED").when(F.col("n_gate") > 0, "BLOCKED_GATE").when((F.col("defects") > 0) | over, "NEEDS_REVIEW")
        .when(F.col("attempts") == 0, "CONVERGED").when(F.col("accepted") == 0, "NO_IMPROVEMENT").otherwise("DONE")
    )
    return now.select("doc", status.alias("status"), "attempts", "accepted", "version")
