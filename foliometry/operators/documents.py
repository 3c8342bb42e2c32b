"""Documents against reference profiles: strata with fallback, distances with missing measures, scores, and trials on them.

A page belongs to one stratum of each level; it is scored by the first whose confidence suffices. Measures travel as one array in
the order of `dims`; a missing one stays null. Strata, their matrices and the patterns of missing measures are small tables
that Spark joins; numpy inverts one small matrix for each (stratum, pattern).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions.scalar import band_loss, robust_z
from foliometry.operators import series
from foliometry.operators.aggregates import ranks_of
from foliometry.operators.lineage import cut
from foliometry.operators.quantiles import joined, percentiles
from foliometry.operators.sampling import scrambled
from foliometry.operators.statistics import chi2_tail

#: Levels in the order in which a page's stratum is picked.
LEVELS = (("venue_role", ("venue", "role")), ("role_layout", ("role", "layout")), ("role", ("role",)))
#: Cap of a normalised loss, weight of the distance, level of an anomalous page, papers of a medium tier.
LOSS_CAP, D2_WEIGHT, ANOMALY, MEDIUM = 20.0, 1.0, 0.05, 16
PAGE = ["paper", "page", "venue", "role", "layout"]


def chi2_upper(x: Column, k: Column, most: int) -> Column:
    """Upper tail of chi-square for k degrees of freedom, 1 <= k <= most: closed forms, and a series for odd k."""
    h = x / 2.0
    step = lambda s, i: F.struct((s["t"] * h / (i + 0.5)).alias("t"), (s["sum"] + s["t"] * h / (i + 0.5)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(250)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum")), step, lambda s: s["sum"])
    odd = F.when(h > 100, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.sqrt(h) * F.exp(-h) / math.gamma(1.5) * series))
    out = F.lit(None).cast("double")
    for n in range(1, most + 1):
        if n % 2 == 0:
            tail = chi2_tail(x, n)
        else:
            tail = odd + sum((F.pow(h, m / 2) * F.exp(-h) / math.gamma(m / 2 + 1) for m in range(1, n - 1, 2)), F.lit(0.0))
        out = F.when(k == n, F.least(F.lit(1.0), tail)).otherwise(out)
    return out


@dataclass
class Profile:
    """Strata (bands, scales, reference values, confidence) and the inverse of each stratum and pattern of measures."""

    dims: list[str]
    strata: DataFrame
    inverses: DataFrame
    weights: dict[str, float] = field(default_factory=dict)


def _strata() -> list[Column]:
    """A page's level (its place) and stratum, for each level."""
    return [F.struct(F.lit(i).alias("level"), F.concat_ws("|", F.lit(name), *keys).alias("stratum")) for i, (name, keys) in enumerate(LEVELS)]


def _each(n: int, f: object) -> Column:
    return F.array(*[f(i) for i in range(n)])


def measured(rows: DataFrame, n: int) -> DataFrame:
    """rows (with x and a stratum's arrays) with z, loss and pattern; a measure missing on either side is null."""
    at = lambda c, i: F.get(c, F.lit(i))
    z = _each(n, lambda i: F.when(at("x", i).isNotNull() & at("center", i).isNotNull(), robust_z(at("x", i), at("center", i), at("scale", i))))
    loss = _each(n, lambda i: F.when(at("x", i).isNotNull() & at("center", i).isNotNull(), band_loss(at("x", i), at("lo", i), at("hi", i), at("scale", i))))
    rows = rows.withColumn("z", z).withColumn("loss", loss)
    return rows.withColumn("pattern", sum((F.when(at("z", i).isNotNull(), 1 << i).otherwise(0) for i in range(n)), F.lit(0)))


def with_distance(rows: DataFrame, inverses: DataFrame, n: int) -> DataFrame:
    """rows with d2, k (measures used) and p; null where no measure is there."""
    z = lambda i: F.coalesce(F.get("z", i), F.lit(0.0))
    if n <= 8:  # written out, Spark compiles it
        form = sum((z(F.lit(e // n)) * z(F.lit(e % n)) * F.get("inverse", F.lit(e)) for e in range(n * n)), F.lit(0.0))
    else:
        form = F.aggregate(F.sequence(F.lit(0), F.lit(n * n - 1)), F.lit(0.0), lambda s, e: s + z(F.floor(e / n).cast("int")) * z(e % n) * F.get("inverse", e))
    rows = rows.join(inverses, ["stratum", "pattern"], "left").withColumn("d2", F.greatest(F.lit(0.0), F.when(F.col("pattern") > 0, form))).drop("inverse")
    rows = rows.withColumn("d2", F.when(F.col("pattern") > 0, F.col("d2"))).withColumn("k", F.bit_count("pattern"))
    return rows.withColumn("p", F.when(F.col("d2") <= 0, 1.0).otherwise(chi2_upper(F.col("d2"), F.col("k"), n)))


def _inverse(m: np.ndarray, pattern: int) -> np.ndarray:
    """The inverse of the part of a matrix that a pattern has, with zeros elsewhere; the identity where there is none."""
    own = [i for i in range(len(m)) if pattern >> i & 1]
    part, full = m[np.ix_(own, own)], np.zeros(m.shape)
    try:
        full[np.ix_(own, own)] = np.linalg.inv(part) if np.linalg.cond(part) < 1e12 else np.eye(len(own))
    except np.linalg.LinAlgError:
        full[np.ix_(own, own)] = np.eye(len(own))
    return full


def pattern_inverses(correlation: DataFrame, patterns: DataFrame, dims: list[str]) -> DataFrame:
    """(stratum, pattern, inverse): the inverse of the shrunk correlation of the measures that the pattern has, with zeros elsewhere.

    A stratum without correlations, or a matrix that cannot be inverted, has the identity.
    """
    n = len(dims)
    pairs = correlation.groupBy("stratum").agg(F.collect_list(F.struct("a", "b", "shrunk")).alias("pairs"))  # n (n - 1) / 2 of them

    def run(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            out = []
            for pattern, found in zip(rows["pattern"], rows["pairs"], strict=True):
                m = np.eye(n)
                for pair in found if found is not None else ():
                    i, j, v = dims.index(pair["a"]), dims.index(pair["b"]), pair["shrunk"]
                    m[i, j] = m[j, i] = 0.0 if v is None or not np.isfinite(v) else v
                out.append(_inverse(m, int(pattern)).ravel().tolist())
            yield pd.DataFrame({"stratum": rows["stratum"], "pattern": rows["pattern"], "inverse": out})

    return patterns.join(pairs, "stratum", "left").mapInPandas(run, "stratum string, pattern int, inverse array<double>")


@dataclass
class _Bands:
    """A profile's strata as arrays (a row for each stratum), which go to the tasks; `known` tells which measures have bands."""

    names: list[str]
    known: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def measured(self, s: np.ndarray, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """measured() of rows by their stratum's number: which measures count, z, loss (only where they count)."""
        scale = self.scale[s]
        has = there & self.known[s]
        with np.errstate(all="ignore"):
            z = np.fmax(-4.0, np.fmin(4.0, (x - self.center[s]) / scale))
            over, under = np.isnan(x) | (x > self.hi[s]), x < self.lo[s]
            loss = np.where(over, (x - self.hi[s]) / scale, np.where(under, 1.2 * (self.lo[s] - x) / scale, 0.0))
        return has, z, loss


def _patterns(has: np.ndarray) -> np.ndarray:
    return has @ (np.int64(1) << np.arange(has.shape[1], dtype=np.int64))


@dataclass
class _Inverses:
    """The inverses by stratum and pattern as arrays."""

    keys: np.ndarray
    cells: np.ndarray

    def distance(self, s: np.ndarray, has: np.ndarray, z: np.ndarray) -> np.ndarray:
        """d2 of each row, which means nothing where no measure counts."""
        n = z.shape[1]
        z, key = np.ascontiguousarray(np.where(has, z, 0.0).T), s << n | _patterns(has)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        missed = np.flatnonzero((self.keys[at] != key) & has.any(axis=1))
        table, out = self.cells, np.zeros(len(key))
        if len(missed):
            others, place = np.unique(key[missed], return_inverse=True)
            at[missed] = len(table) + place
            table = np.concatenate([table, [self._other(k, n) for k in others.tolist()]])
        table = np.ascontiguousarray(table.T)
        for e in range(n * n):
            out += z[e // n] * z[e % n] * table[e][at]
        return np.maximum(0.0, out)

    def _other(self, key: int, n: int) -> np.ndarray:
        """The inverse of a pattern that no page of the profile has, from the correlation of its complete pages (or else the identity)."""
        whole = key | (1 << n) - 1
        at = min(int(np.searchsorted(self.keys, whole)), len(self.keys) - 1)
        matrix = np.linalg.inv(self.cells[at].reshape(n, n)) if self.keys[at] == whole else np.eye(n)
        return _inverse(matrix, key & (1 << n) - 1).ravel()


def _inverse_arrays(inverses: DataFrame, names: list[str], n: int) -> _Inverses:
    place = {name: k for k, name in enumerate(names)}
    rows = sorted((place[r.stratum] << n | r.pattern, r.inverse) for r in inverses.collect() if r.stratum in place)
    return _Inverses(np.array([k for k, _ in rows] or [-1], np.int64), np.array([v for _, v in rows] or [[0.0] * (n * n)]))


def _cells(pages: DataFrame) -> tuple[DataFrame, list[list[str]]]:
    """venue, role, layout and cell, the number of each combination (a small table); and each cell's strata by level."""
    found = pages.groupBy("venue", "role", "layout").count().drop("count")
    cells = cut(found.withColumn("cell", F.row_number().over(W.orderBy("venue", "role", "layout")) - 1))  # as small as the strata
    return cells, [list(r[1]) for r in sorted(cells.select("cell", F.array(*[s["stratum"] for s in _strata()])).collect())]


def _coded(pages: DataFrame, cells: DataFrame, dims: list[str], *more: str) -> DataFrame:
    """cell and the measures of each page, and other columns behind."""
    return joined(pages, F.broadcast(cells), ["venue", "role", "layout"]).select("cell", *[F.col(d).cast("double").alias(d) for d in dims], *more)


def _measures_of(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's cells, measures, and which measures are there."""
    columns = [batch.column(i) for i in range(1, n + 1)]
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
    return batch.column(0).to_numpy().astype(np.int64), x, np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


def _moments(n: int, bands: _Bands, of: np.ndarray) -> object:
    """Batches to rows of a stratum and pattern: pages, and for complete pages sums of z, their products and squares, least and largest z."""
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    full = (1 << n) - 1

    def run(batches):  # noqa: ANN001, ANN202
        seen, sums, ends = {}, np.zeros((len(bands.names), n + 2 * len(pairs))), np.full((len(bands.names), 2 * n), -np.inf)
        for batch in batches:
            cell, x, there = _measures_of(batch, n)
            for level in range(of.shape[1]):
                s = of[cell, level]
                has, z, _ = bands.measured(s, x, there)
                key, times = np.unique(s << n | _patterns(has), return_counts=True)
                for k, c in zip(key.tolist(), times.tolist(), strict=True):
                    seen[k] = seen.get(k, 0) + c
                whole = has.all(axis=1)
                order = np.argsort(s[whole], kind="stable")
                own, z = s[whole][order], z[whole][order]
                if not len(own):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                products = np.column_stack([z[:, i] * z[:, j] for i, j in pairs])
                sums[own[starts]] += np.add.reduceat(np.concatenate([z, products, products * products], axis=1), starts)
                ends[own[starts]] = np.maximum(ends[own[starts]], np.maximum.reduceat(np.concatenate([z, -z], axis=1), starts))
        for k, c in seen.items():
            s, pattern = k >> n, k & full
            of_whole = pattern == full
            yield pd.DataFrame({"s": [s], "pattern": [pattern], "n": [c], "sums": [sums[s].tolist() if of_whole else None], "ends": [ends[s].tolist() if of_whole else None]})

    def arrow(batches):  # noqa: ANN001, ANN202
        schema = pa.schema([("s", pa.int64()), ("pattern", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())), ("ends", pa.list_(pa.float64()))])
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    return arrow


def _shrunk(row: object, n: int) -> np.ndarray:
    """shrunk_correlation() of a stratum from its sums, as a matrix; the identity where it has none."""
    out, pairs = np.eye(n), [(i, j) for i in range(n) for j in range(i, n)]
    count, sums, ends = row["n"], np.array(row["sums"]), np.array(row["ends"])
    if count < 2 or (ends[:n] == -ends[n:]).any():  # a measure that does not vary has no correlation, and then nothing is left of the others
        return out
    mean = sums[:n] / count
    product = {p: sums[n + k] for k, p in enumerate(pairs)}
    square = {p: sums[n + len(pairs) + k] for k, p in enumerate(pairs)}
    deviation = [math.sqrt(max(0.0, product[i, i] / count - mean[i] ** 2)) for i in range(n)]
    apart = [p for p in pairs if p[0] < p[1]]
    r = {(i, j): (product[i, j] / count - mean[i] * mean[j]) / (deviation[i] * deviation[j]) if deviation[i] * deviation[j] else math.nan for i, j in apart}
    total = sum(v * v for v in r.values())
    spread = sum(max(0.0, (square[p] - product[p] ** 2 / count) / (count - 1)) for p in apart)
    delta = max(0.0, min(1.0, spread / count / total)) if total > 0 and math.isfinite(total) else 1.0
    for (i, j), v in r.items():
        out[i, j] = out[j, i] = (1 - delta) * v if math.isfinite(v) else 0.0
    return out


def fit(pages: DataFrame, dims: list[str], least_papers: int = MEDIUM, weights: dict[str, float] | None = None) -> Profile:
    """The profile of these pages, and reference values of the strata's own pages.

    Pages are read several times, so a table that is dear to make is written first. Tasks make the numbers of a page's levels from
    one row; only counts and sums of strata are shuffled. Strata and their matrices, which are small, reach the driver.
    """
    spark, n = pages.sparkSession, len(dims)
    cells, strata_of = _cells(pages)
    names = sorted({s for row in strata_of for s in row})
    place = {s: k for k, s in enumerate(names)}
    of = np.array([[place[s] for s in row] for row in strata_of], np.int64).reshape(-1, len(LEVELS))
    coded = _coded(pages, cells, dims)

    def raw(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        cell, x, there = _measures_of(batch, n)
        return (cell[:, None] * n + np.arange(n))[there], x[there]

    deal = spark.createDataFrame([(c * n + i, int(s) * n + i) for c, row in enumerate(of) for s in row for i in range(n)], "part long, series long")
    bands = _Bands(names, np.zeros((len(names), n), bool), *(np.full((len(names), n), np.nan) for _ in range(4)))
    for r in series.quantiles(coded, raw, (0.1, 0.25, 0.5, 0.75, 0.9), deal).collect():
        s, i = divmod(r.series, n)
        p10, p25, p50, p75, p90 = r.p
        iqr, wide = p75 - p25, p90 - p10
        thin = iqr < 0.1 * wide
        bands.known[s, i], bands.center[s, i] = True, p50
        bands.scale[s, i] = iqr if iqr > 1e-9 else wide / 2.563 if wide > 1e-9 else 1e-6
        bands.lo[s, i], bands.hi[s, i] = (p10, p90) if thin else (p25, p75)
    papers = pages.groupBy("paper", "venue", "role", "layout").agg(F.count("*").alias("c")).select("paper", "c", F.explode(F.array(*_strata())).alias("s"))
    papers = papers.groupBy("s.stratum", "paper").agg(F.sum("c").alias("c")).groupBy("stratum").agg(F.count("*").alias("n_papers"), F.sum("c").alias("n_pages"))

    made = coded.mapInArrow(_moments(n, bands, of), "s long, pattern long, n long, sums array<double>, ends array<double>")
    width = n + n * (n + 1)
    sums = [F.array(*[f(F.get(c, F.lit(i))) for i in range(w)]).alias(c) for c, f, w in (("sums", F.sum, width), ("ends", F.max, 2 * n))]
    moments = made.groupBy("s", "pattern").agg(F.sum("n").alias("n"), *sums).collect()
    matrices = {r.s: _shrunk(r, n) for r in moments if r.pattern == (1 << n) - 1}
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    correlation = spark.createDataFrame([(names[s], dims[i], dims[j], float(m[i, j])) for s, m in matrices.items() for i, j in pairs], "stratum string, a string, b string, shrunk double")
    patterns = spark.createDataFrame([(names[r.s], r.pattern) for r in moments if r.pattern], "stratum string, pattern int")
    inverses = cut(pattern_inverses(correlation, patterns, dims))
    found = _inverse_arrays(inverses, names, n)

    def losses(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Losses of each level and measure, and the distance as one more measure."""
        cell, x, there = _measures_of(batch, n)
        parts, values = [], []
        for level in range(len(LEVELS)):
            s = of[cell, level]
            has, z, loss = bands.measured(s, x, there)
            some = has.any(axis=1)
            parts += [(s[:, None] * (n + 1) + np.arange(n))[has], s[some] * (n + 1) + n]
            values += [loss[has], found.distance(s, has, z)[some]]
        return np.concatenate(parts), np.concatenate(values)

    refs = {r.series: r.p[0] for r in series.quantiles(coded, losses, (0.9,)).collect()}
    given = {r.stratum: (r.n_papers, r.n_pages) for r in papers.collect()}
    array = lambda a, s: [float(v) if k else None for v, k in zip(a[s], bands.known[s], strict=True)]
    rows = [
        (name, *(array(a, s) for a in (bands.center, bands.scale, bands.lo, bands.hi)), *given[name], given[name][0] >= least_papers, refs.get(s * (n + 1) + n), [refs.get(s * (n + 1) + i) for i in range(n)])
        for s, name in enumerate(names) if bands.known[s].any()
    ]
    many = "array<double>"
    schema = f"stratum string, center {many}, scale {many}, lo {many}, hi {many}, n_papers long, n_pages long, usable boolean, d2_ref double, loss_ref {many}"
    return Profile(dims, spark.createDataFrame(rows, schema), inverses, weights or {})


def _tail(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """chi2_upper() of rows in a task; 1 where the distance is 0."""
    out = np.ones(len(x))
    for n in np.unique(k[k > 0]).tolist():
        own = np.flatnonzero((k == n) & (x > 0))
        h = x[own] / 2.0
        with np.errstate(all="ignore"):
            e = np.exp(-h)
            if n % 2 == 0:
                term, total = np.ones(len(h)), np.ones(len(h))
                for i in range(1, n // 2):
                    term = term * x[own] / (2.0 * i)
                    total = total + term
                tail = e * total
            else:
                t, total = np.ones(len(h)), np.ones(len(h))
                near = np.where(h > 100, 0.0, h)
                for i in range(1, 251):
                    t = t * near / (i + 0.5)
                    more = total + t
                    if (more == total).all():
                        break
                    total = more
                tail = np.where(h > 100, 0.0, np.maximum(0.0, 1 - np.sqrt(h) * e / math.gamma(1.5) * total))
                tail = tail + sum((np.power(h, m / 2) * e / math.gamma(m / 2 + 1) for m in range(1, n - 1, 2)), 0.0)
        out[own] = np.minimum(1.0, tail)
    return out


def page_scores(pages: DataFrame, profile: Profile, tails: bool = True) -> DataFrame:
    """A row for each page: its stratum (null where none is usable), x, d2, k, p, norm (of each measure) and norm_d2. tails: whether p is asked for."""
    n = len(profile.dims)
    strata = sorted(profile.strata.where("usable").collect(), key=lambda r: r.stratum)
    names = [r.stratum for r in strata]
    table = lambda c: np.array([[math.nan if v is None else v for v in r[c]] for r in strata], float).reshape(-1, n)
    bands = _Bands(names, ~np.isnan(table("center")), table("center"), table("scale"), table("lo"), table("hi"))
    found = _inverse_arrays(profile.inverses, names, n)
    positive = lambda a: np.where(a > 0, a, 1.0)
    loss_ref, d2_ref = positive(table("loss_ref")), positive(np.array([math.nan if r.d2_ref is None else r.d2_ref for r in strata], float))
    cells, strata_of = _cells(pages)
    place = {s: k for k, s in enumerate(names)}
    pick = np.array([next((place[s] for s in row if s in place), -1) for row in strata_of], np.int64)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            cell, x, there = _measures_of(batch, n)
            s = pick[cell]
            ok = s >= 0
            at = np.where(ok, s, 0)
            if names:
                has, z, loss = bands.measured(at, x, there)
                has &= ok[:, None]
                d2 = found.distance(at, has, z)
                norm = np.minimum(LOSS_CAP, loss / loss_ref[at])
                norm_d2 = d2 / d2_ref[at]
            else:
                has, d2, norm, norm_d2 = np.zeros(x.shape, bool), np.zeros(len(x)), x, np.zeros(len(x))
            k, some = has.sum(axis=1), has.any(axis=1)
            p = _tail(np.where(some, d2, 0.0), k) if tails else np.zeros(len(x))
            offsets = np.arange(0, x.size + 1, n, dtype=np.int32)
            lists = lambda v, there: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel(), mask=~there.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(n + 1, n + 1 + len(PAGE))], pa.DictionaryArray.from_arrays(pa.array(s.astype(np.int32), mask=~ok), pa.array(names, pa.string())).cast(pa.string()), lists(x, there),
                    pa.array(d2, mask=~some), pa.array(k.astype(np.int32)), pa.array(p, mask=~some | (not tails)), lists(norm, has), pa.array(norm_d2, mask=~some),
                ],
                names=[*PAGE, "stratum", "x", "d2", "k", "p", "norm", "norm_d2"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    page = ", ".join(f"{c} {kinds[c]}" for c in PAGE)
    return _coded(pages, cells, profile.dims, *PAGE).mapInArrow(run, f"{page}, stratum string, x array<double>, d2 double, k int, p double, norm array<double>, norm_d2 double")


def normalised(rows: DataFrame, n: int) -> DataFrame:
    ref = lambda i: F.get("loss_ref", F.lit(i))
    norm = _each(n, lambda i: F.least(F.lit(LOSS_CAP), F.get("loss", F.lit(i)) / F.when(ref(i) > 0, ref(i)).otherwise(1.0)))
    norm = _each(n, lambda i: F.when(F.get("loss", F.lit(i)).isNotNull(), norm[i]))
    return rows.withColumn("norm", norm).withColumn("norm_d2", F.col("d2") / F.when(F.col("d2_ref") > 0, F.col("d2_ref")).otherwise(1.0))


def pools(scores: DataFrame, profile: Profile) -> DataFrame:
    """A row for each document and measure (a dim, or d2): pooled, half the mean of the top values plus half the mean of all.

    With what a changed value needs (see replaced()): size, sum, k (how many values are on top), top (their sum), last and next (the
    least of them, and the largest of the others). A document's pages meet once, as one row a page.
    """
    n = len(profile.dims)
    values = [F.get("norm", F.lit(i)) for i in range(n)] + [F.col("norm_d2")]
    lists = [F.sort_array(F.collect_list(v), asc=False).alias(f"l{i}") for i, v in enumerate(values)]
    papers = scores.where("stratum is not null").groupBy("paper").agg(F.count("*").alias("n_ok"), *lists)
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"l{i}").alias("l")) for i, m in enumerate([*profile.dims, "d2"])])
    rows = papers.select("paper", "n_ok", F.explode(each).alias("e")).select("paper", "e.measure", "e.l", F.size("e.l").alias("size"), F.greatest(F.lit(1), F.bround(0.05 * F.col("n_ok")).cast("int")).alias("k")).where("size > 0")
    rows = rows.withColumn("k", F.least("k", "size"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = rows.select("paper", "measure", "size", "k", add("l").alias("sum"), add(F.slice("l", F.lit(1), F.col("k"))).alias("top"), F.get("l", F.col("k") - 1).alias("last"), F.get("l", F.col("k")).alias("next"))
    return rows.withColumn("pooled", _pooled("sum", "top"))


def _pooled(total: Column | str, top: Column | str) -> Column:
    return 0.5 * (top if isinstance(top, Column) else F.col(top)) / F.col("k") + 0.5 * (total if isinstance(total, Column) else F.col(total)) / F.col("size")


def replaced(old: Column, new: Column) -> Column:
    """pooled of a row of pools() with one of its values changed: no list is sorted again."""
    on_top = old >= F.col("last")
    others = F.col("top") - F.when(on_top, old).otherwise(F.col("last"))
    rival = F.when(on_top, F.col("next")).otherwise(F.col("last"))
    return _pooled(F.col("sum") - old + new, others + F.greatest(new, rival))  # a missing rival is passed over


def _weight(profile: Profile) -> Column:
    out = F.lit(1.0)
    for d, w in [*profile.weights.items(), ("d2", D2_WEIGHT)]:
        out = F.when(F.col("measure") == d, F.lit(float(w))).otherwise(out)
    return out


def reports(scores: DataFrame, profile: Profile) -> DataFrame:
    """A row for each document: a_profile, pages, scored and anomalous pages, the most distant page, and the strata used."""
    total = pools(scores, profile).groupBy("paper").agg((F.sum(_weight(profile) * F.col("pooled")) / F.sum(_weight(profile))).alias("a_profile"))
    g = scores.groupBy("paper").agg(
        F.count("*").alias("n_pages"), F.count("stratum").alias("n_scored"), F.count_if(F.col("p") < ANOMALY).alias("n_anomalous"),
        F.max(F.when(F.col("d2").isNotNull(), F.struct(F.round("d2", 6).alias("d"), (-F.col("page")).alias("page")))).alias("top"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("stratum").isNotNull(), F.concat_ws("=", "role", "stratum")))), ",").alias("levels_used"),
    )
    return g.join(total, "paper", "left").select("paper", "a_profile", "n_pages", "n_scored", "n_anomalous", (-F.col("top.page")).alias("top_page"), F.col("top.d").alias("top_d2"), "levels_used")


def ladder(rows: DataFrame, unit: tuple[str, ...], non_negative: tuple[str, ...]) -> DataFrame:
    """rows (dim, v0, scale) by sign, step (1 to 4), alpha and v: quarters of the headroom where a bound is, else 0.5, 1, 2, 4 scales.

    No rows where there is no room.
    """
    signed = rows.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(4))))
    bound = F.when(F.col("dim").isin(*unit), F.when(F.col("sign") > 0, 1.0).otherwise(0.0)).when(F.col("dim").isin(*non_negative) & (F.col("sign") < 0), 0.0)
    room = F.col("sign") * (bound - F.col("v0"))
    a = F.when(room.isNotNull(), F.when(room > 1e-9, room * F.col("step") / 4)).otherwise(F.col("scale") * 0.5 * F.pow(F.lit(2.0), F.col("step") - 1))
    return signed.withColumn("__a", a).where("__a is not null").select(*rows.columns, "sign", "step", F.round(F.col("__a") / F.col("scale"), 6).alias("alpha"), F.round(F.col("v0") + F.col("sign") * F.col("__a"), 6).alias("v"))


def _targets(scores: DataFrame, papers: int | None, least_pages: int = 3) -> DataFrame:
    """One page of each paper (or of so many papers), both in a seeded order; papers of fewer pages have none."""
    first = scores.groupBy("paper").agg(F.count("*").alias("n"), F.min(F.struct(scrambled("page", "paper").alias("o"), "page")).alias("f")).where(F.col("n") >= least_pages)
    if papers is not None:
        first = first.join(scores.where("stratum is not null").select("paper", "page").alias("s"), (F.col("s.paper") == first.paper) & (F.col("s.page") == F.col("f.page")), "left_semi").orderBy(scrambled("paper"), "paper").limit(papers)
    return scores.join(cut(first.select("paper", "f.page")), ["paper", "page"]).where("stratum is not null")


def degradations(scores: DataFrame, profile: Profile, unit: tuple[str, ...], non_negative: tuple[str, ...], papers: int | None = None) -> DataFrame:
    """Ladders of one page a paper and every measure, in the direction that raises its loss: steady rises first, then the larger.

    A row for each step, 0 (as it is) to 4, with dim, v, d2, the measure's norm (own) and norm_d2 at that step, and both as they are (old, old_d2).
    """
    n, dims = len(profile.dims), profile.dims
    targets = _targets(scores, papers).select("paper", "page", "role", "stratum", "x", F.col("norm").alias("norms"), F.col("norm_d2").alias("old_d2"))
    targets = cut(targets.join(profile.strata.select("stratum", "center", "scale", "lo", "hi", "d2_ref", "loss_ref"), "stratum"))
    each = targets.select("*", F.posexplode("x").alias("i", "v0")).withColumn("dim", F.get(F.array(*map(F.lit, dims)), F.col("i")))
    each = each.where("v0 is not null").withColumnRenamed("scale", "scales").withColumn("scale", F.get("scales", "i")).withColumn("old", F.get("norms", "i"))
    rungs = ladder(each, unit, non_negative)
    start = rungs.where("step = 1").withColumn("step", F.lit(0)).withColumn("alpha", F.lit(0.0)).withColumn("v", F.col("v0"))
    rungs = rungs.unionByName(start).drop("scale").withColumnRenamed("scales", "scale")
    moved = F.transform("x", lambda v, k: F.when(k == F.col("i"), F.col("v")).otherwise(v))
    scored = normalised(with_distance(measured(rungs.withColumn("x", moved), n), profile.inverses, n), n).withColumn("own", F.get("norm", "i"))
    scored = cut(scored.select("paper", "page", "role", "stratum", "dim", "sign", "step", "alpha", "v", "d2", "own", "norm_d2", "old", "old_d2"))
    w = W.partitionBy("paper", "dim", "sign").orderBy("step")
    falls = scored.withColumn("__d", F.col("own") - F.lag("own").over(w)).groupBy("paper", "dim", "sign").agg(
        F.coalesce(F.min("__d") >= -1e-9, F.lit(False)).cast("int").alias("mono"), (F.max_by("own", "step") - F.min_by("own", "step")).alias("rise")
    )
    best = falls.where("rise > 1e-9").groupBy("paper", "dim").agg(F.max(F.struct("mono", F.round("rise", 9).alias("rise"), "sign")).alias("b"))
    return scored.join(best.select("paper", "dim", "b.sign"), ["paper", "dim", "sign"])


def _document_scores(rungs: DataFrame, pooled: DataFrame, profile: Profile) -> DataFrame:
    """(paper, dim, step, a): the document's score with the page changed. Only the changed measure and the distance are pooled anew."""
    parts = F.map_from_entries(F.collect_list(F.struct("measure", F.struct("size", "k", "sum", "top", "last", "next", "pooled", _weight(profile).alias("w")))))
    papers = pooled.groupBy("paper").agg(parts.alias("m"), F.sum(_weight(profile) * F.col("pooled")).alias("total"), F.sum(_weight(profile)).alias("weight"))
    a = rungs.select("paper", "dim", "step", "own", "old", "norm_d2", "old_d2").join(papers, "paper")
    for measure, old, new in ((F.col("dim"), "old", "own"), (F.lit("d2"), "old_d2", "norm_d2")):
        a = a.withColumn("e", F.try_element_at("m", measure)).select(*a.columns, "e.*")
        a = a.withColumn("total", F.col("total") + F.col("w") * (replaced(F.col(old), F.col(new)) - F.col("pooled"))).drop("size", "k", "sum", "top", "last", "next", "pooled", "w")
    return a.select("paper", "dim", "step", (F.col("total") / F.col("weight")).alias("a"))


def injection_trials(scores: DataFrame, profile: Profile, unit: tuple[str, ...], non_negative: tuple[str, ...], papers: int | None = None) -> DataFrame:
    """A row for each paper and measure: whether the document's score rises steadily, by how much, and the changed page's rank by distance."""
    rungs = cut(degradations(scores, profile, unit, non_negative, papers))
    a = _document_scores(rungs, cut(pools(scores, profile)), profile)
    w = W.partitionBy("paper", "dim").orderBy("step")
    d = a.withColumn("__d", F.round("a", 6) - F.lag(F.round("a", 6)).over(w)).withColumn("__tol", 1e-4 * F.greatest(F.abs(F.lag("a").over(w)), F.lit(1e-9)))
    series = d.groupBy("paper", "dim").agg(
        (F.count_if(F.col("__d") < -F.col("__tol")) == 0).alias("monotone"), (F.count_if(F.col("__d") > 0) == F.max("step")).alias("strict"), (F.max_by("a", "step") - F.min_by("a", "step")).alias("delta")
    )
    last = rungs.where("step = 4").select("paper", "dim", "page", "role", "stratum", "sign", F.col("d2").alias("changed"))
    # a paper's distances are one list; that of the page itself, before, does not count
    theirs = scores.groupBy("paper").agg(F.collect_list("d2").alias("theirs"), F.collect_list(F.when(F.col("d2").isNotNull(), F.col("page"))).alias("pages"))
    above = F.filter(F.arrays_zip("theirs", "pages"), lambda o: (o["theirs"] > F.col("changed")) & (o["pages"] != F.col("page")))
    out = last.join(theirs, "paper").withColumn("rank", 1 + F.size(above).cast("long")).drop("theirs", "pages", "changed").join(series, ["paper", "dim"])
    return out.withColumn("localized", F.col("rank") <= 3)


def ablation_trials(scores: DataFrame, profile: Profile, unit: tuple[str, ...], non_negative: tuple[str, ...], papers: int | None = None, step: int = 2) -> DataFrame:
    """One page of each paper with each of its measures changed in turn, at a middle step: delta of each measure's pooled loss, and its value before."""
    chosen = degradations(scores, profile, unit, non_negative, papers).where(F.col("step") == step)
    rows = chosen.select("paper", "page", "role", "stratum", "dim", "sign", "alpha", "own", "old", "norm_d2", "old_d2").join(pools(scores, profile), "paper")
    after = F.when(F.col("measure") == F.col("dim"), replaced(F.col("old"), F.col("own"))).when(F.col("measure") == "d2", replaced(F.col("old_d2"), F.col("norm_d2"))).otherwise(F.col("pooled"))
    rows = rows.withColumn("before", F.col("pooled")).withColumn("after", after).withColumn("delta", F.col("after") - F.col("before"))
    return rows.select("paper", "page", "role", "stratum", "dim", "sign", "alpha", "measure", "before", "after", "delta")


def _sides(trials: DataFrame, dims: list[str]) -> DataFrame:
    """paper, measure, side, value and __m, how many trials have it: deltas of the changed measure (signal), what unchanged ones have anyway (noise)."""
    rows = trials.where(F.col("measure").isin(*dims)).withColumn("side", F.when(F.col("measure") == F.col("dim"), "signal").otherwise("noise"))
    value = F.when(F.col("side") == "signal", F.col("delta")).otherwise(F.greatest(F.lit(0.0), F.col("before")))
    return rows.groupBy("paper", "measure", "side", value.alias("value")).agg(F.count("*").alias("__m"))


def _signal_noise(sides: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """(keys, dim, signal, noise, weight) of weighted trials: upper median of a changed measure's delta over the P90 of unchanged ones."""
    rows = sides
    signal = weighted_rank(rows.where("side = 'signal'"), [*keys, "measure"], lambda n: F.floor(n / 2), "signal")
    noise = weighted_rank(rows.where("side = 'noise'"), [*keys, "measure"], lambda n: F.bround(0.9 * (n - 1)), "noise")
    base = rows.select(*keys).distinct() if keys else rows.select(F.lit(1).alias("__one")).limit(1)
    grid = base.withColumn("measure", F.explode(F.array(*map(F.lit, dims))))
    both = grid.join(signal, [*keys, "measure"], "left").join(noise, [*keys, "measure"], "left")
    ratio = F.col("signal") / (F.coalesce("noise", F.lit(0.0)) + 0.05)
    raw = F.coalesce(F.greatest(F.lit(0.25), F.least(F.lit(4.0), ratio)), F.lit(4.0))
    mean = F.avg("raw").over(W.partitionBy(*(keys or [F.lit(1)])))
    weight = F.round(F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.col("raw") / mean)), 4)
    return both.withColumn("raw", raw).withColumn("weight", weight).select(*keys, F.col("measure").alias("dim"), "signal", "noise", "weight")


def false_positives(pages: DataFrame, dims: list[str], fold: str, folds: int, least_papers: int = MEDIUM, least_train: int = 20) -> DataFrame:
    """Rates by role, and for all (role null), at which held-out pages are called anomalous, pooled over the folds.

    chi2: the tail is below ANOMALY; p95, p96, p97: the distance is above that quantile of the role's training pages, where
    there are at least least_train of them; top_dim: the measure that is most often the worst of a page called so by chi2.
    """

    def tested(k: int) -> DataFrame:
        train, test = (pages.where(c) for c in (F.col(fold) != k, F.col(fold) == k))
        profile = fit(train, dims, least_papers)
        own = cut(page_scores(train, profile, tails=False).where("d2 is not null").select("role", "d2"))
        limits = percentiles(own, ["role"], (0.95, 0.96, 0.97), "d2").where(F.col("n") >= least_train).select("role", "p")
        worst = F.array_max(F.filter(F.arrays_zip(F.col("norm").alias("v"), F.array(*map(F.lit, dims)).alias("d")), lambda x: x["v"].isNotNull()))["d"]
        rows = page_scores(test, profile).where("d2 is not null").select("role", "d2", F.col("p").alias("tail"), worst.alias("worst"))
        return cut(rows.join(limits, "role", "left"))

    with ThreadPoolExecutor(folds) as pool:  # a profile for each fold; their short jobs fill each other's gaps
        rows = reduce(DataFrame.unionByName, pool.map(tested, range(folds)))
    over = [F.avg(F.when(F.col("p").isNotNull(), (F.col("d2") > F.col("p")[i]).cast("double"))).alias(c) for i, c in enumerate(("p95", "p96", "p97"))]
    rates = [F.count("*").alias("n"), F.avg((F.col("tail") < ANOMALY).cast("double")).alias("chi2"), *over, F.mode(F.when(F.col("tail") < ANOMALY, F.col("worst")), True).alias("top_dim")]
    return rows.groupBy("role").agg(*rates).unionByName(rows.agg(*rates).withColumn("role", F.lit(None).cast("string")))


def weighted_rank(rows: DataFrame, keys: list[str], rank: object, name: str) -> DataFrame:
    """The value at a 0-based rank of each group, rows counted __m times. Groups are the trials of a measure: one a paper."""
    w = W.partitionBy(*keys)
    upto = rows.withColumn("__upto", F.sum("__m").over(w.orderBy("value").rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.sum("__m").over(w))
    return upto.groupBy(*keys).agg(F.min(F.when(F.col("__upto") > rank(F.col("__n")), F.col("value"))).alias(name))


def trial_weights(trials: DataFrame, dims: list[str]) -> DataFrame:
    """Signal, noise and weight of each measure: ratio clipped to 0.25..4, brought to mean 1, clipped again."""
    return _signal_noise(cut(_sides(trials, dims)), [], dims)


def weights_bootstrap(trials: DataFrame, dims: list[str], rounds: int = 200) -> DataFrame:
    """(dim, low, high): the 5 % and 95 % ranks of the weights over resampled papers. Trials are weighted, not copied."""
    from foliometry.operators.evaluation import bootstrap_counts

    sides = cut(_sides(trials, dims))
    counts = bootstrap_counts(cut(sides.select("paper").distinct()), "paper", rounds)
    rows = sides.join(counts, "paper").select("iter", "measure", "side", "value", (F.col("__m") * F.col("mult")).alias("__m"))
    weights = _signal_noise(rows, ["iter"], dims)
    return ranks_of(weights, ["dim"], {"low": F.floor(0.05 * (F.col("n") - 1)), "high": F.floor(0.95 * (F.col("n") - 1))}, "weight").select("dim", "low", "high")
