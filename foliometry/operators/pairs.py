"""Pairs of pages summed up for each page, without making the pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def below(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each point, how many points are smaller in both coordinates; n log n, one bit of u's ranks after the other."""
    r, s = np.unique(u, return_inverse=True)[1].astype(np.int64), np.unique(v, return_inverse=True)[1].astype(np.int64)
    out = np.zeros(len(r), np.int64)
    for k in range(int(r.max(initial=0)).bit_length()):
        order = np.lexsort((s, r >> (k + 1)))
        group, one = r[order] >> (k + 1), (r[order] >> k & 1) == 1
        key = group * (s.max() + 1) + s[order]
        zeros = np.concatenate([[0], np.cumsum(~one)])
        out[order] += np.where(one, zeros[np.searchsorted(key, key)] - zeros[np.searchsorted(group, group)], 0)
    return out


def partners(rows: DataFrame, paper: str, page: str, col: str, a: str, b: str) -> DataFrame:
    """For each page: how many other pages of its paper it forms pairs with, in how many of them a or b differs most, and the
    partner that differs most in one of them (ties to the smaller page; none where there is no other page).

    The farthest partner has the least or greatest a or b of the paper. |da| >= |db| unless a + b and a - b move in opposite
    directions, which is counted by rank. A page with rows of several columns, which form no pair, is compared row by row.
    Values are taken to six places. A group is one paper.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values([page, col], kind="stable")
        p, x, y = f[page].to_numpy(), f[a].to_numpy().round(6), f[b].to_numpy().round(6)
        n, u, v = len(p), (x + y).round(6), (x - y).round(6)
        count, lead_b = np.full(n, n - 1), below(u, -v) + below(-u, v)
        ends = np.unique([x.argmin(), x.argmax(), y.argmin(), y.argmax()])
        far = np.maximum(np.abs(x[:, None] - x[ends]), np.abs(y[:, None] - y[ends])).round(6)
        best = ends[far.argmax(1)]
        alike = np.flatnonzero(far.max(1) == 0)
        best[alike] = np.where(alike == 0, min(1, n - 1), 0)
        for k in np.flatnonzero(np.isin(p, p[1:][p[1:] == p[:-1]])):
            dx, dy = np.abs(x - x[k]).round(6), np.abs(y - y[k]).round(6)
            other = p != p[k]
            count[k], lead_b[k] = other.sum(), (other & (dx < dy)).sum()
            best[k] = np.where(other, np.maximum(dx, dy), -1).argmax()
        dx, dy, some = np.abs(x - x[best]).round(6), np.abs(y - y[best]).round(6), count > 0
        out = pd.DataFrame({paper: f[paper].to_numpy(), page: p, col: f[col].to_numpy(), "n_pairs": count, "lead_a": count - lead_b, "lead_b": lead_b})
        out["partner"] = pd.Series(p[best], dtype="Int64").where(some)
        out["lead"] = pd.Series(np.where(dx >= dy, "a", "b"), dtype=object).where(some, None)
        return out.assign(lead_delta=pd.Series(np.maximum(dx, dy)).where(some), second_delta=pd.Series(np.minimum(dx, dy)).where(some))

    kind = dict(rows.dtypes)
    found = rows.select(paper, page, col, a, b).groupBy(paper).applyInPandas(run, f"{paper} {kind[paper]}, {page} {kind[page]}, {col} {kind[col]}, n_pairs long, lead_a long, lead_b long, partner {kind[page]}, lead string, lead_delta double, second_delta double")
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("lead_delta", "second_delta")})


def theta_counts(rows: DataFrame, paper: str, col: str, high: str, low: str) -> DataFrame:
    """High and low pages (rows with total, w) with n_pairs: pages of the other side, other papers and the same column, with w(high) >= w(low).

    Counts of the whole column come from its distinct w in order, in buckets of unit width, less those of the page's own paper.
    """
    x = rows.withColumn("side", F.when(F.expr(high), "hi").when(F.expr(low), "lo")).where("side is not null")
    hi, lo = F.when(F.col("side") == "hi", 1).otherwise(0), F.when(F.col("side") == "lo", 1).otherwise(0)
    at = x.groupBy(col, "w").agg(F.sum(hi).alias("hi"), F.sum(lo).alias("lo")).withColumn("bucket", F.floor("w"))
    sums = at.groupBy(col, "bucket").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    order, none = W.partitionBy(col).orderBy("bucket"), F.lit(0)
    outside = sums.select(col, "bucket", F.coalesce(F.sum("lo").over(order.rowsBetween(W.unboundedPreceding, -1)), none).alias("lo_before"), F.coalesce(F.sum("hi").over(order.rowsBetween(1, W.unboundedFollowing)), none).alias("hi_after"))
    inside = W.partitionBy(col, "bucket").orderBy("w")
    up, down = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(0, W.unboundedFollowing)
    whole = at.select(col, "bucket", "w", F.sum("lo").over(up).alias("lo_in"), F.sum("hi").over(down).alias("hi_in")).join(outside, [col, "bucket"])
    whole = whole.select(col, "w", (F.col("lo_before") + F.col("lo_in")).alias("lo_all"), (F.col("hi_after") + F.col("hi_in")).alias("hi_all"))
    own = W.partitionBy(col, paper).orderBy("w")
    mine = x.withColumn("lo_own", F.sum(lo).over(own.rangeBetween(W.unboundedPreceding, 0))).withColumn("hi_own", F.sum(hi).over(own.rangeBetween(0, W.unboundedFollowing)))
    n = F.when(F.col("side") == "hi", F.col("lo_all") - F.col("lo_own")).otherwise(F.col("hi_all") - F.col("hi_own"))
    return mine.join(whole, [col, "w"]).withColumn("n_pairs", n).drop("lo_own", "hi_own", "lo_all", "hi_all")
