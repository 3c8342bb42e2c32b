"""Queries of measures: missing values, validity, components, choice; pairs picked in turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.operators import dims, matching, statistics
from foliometry.operators.lineage import cut
from foliometry.plans.registry import DIMS, PAGES_SQL, Tables, query, with_views
from foliometry.plans.stat_queries import RANKS, SPEAR

#: Of 11 pages so many miss each measure; every second page of role A has no discount (zero).
MISSING = {"quantity": 0, "price": 1, "discount": 2, "tax": 5, "unit_price": 0, "net_price": 1}
LEAST_PAGES = 300
PREFERRED, GROUPS = ["discount", "price"], {"price": "money", "unit_price": "money", "net_price": "money", "discount": "rate", "tax": "rate"}
HOLES = "hole_ AS (SELECT paper, page, venue, role, " + ", ".join(
    f"CASE WHEN (paper * 3 + page * {i + 2}) % 11 >= {n} THEN " + ("CASE WHEN role = 'A' AND page % 2 = 0 THEN 0.0 ELSE discount END" if d == "discount" else d) + f" END AS {d}" for i, (d, n) in enumerate(MISSING.items())
) + " FROM pages_)"


def holed(t: Tables) -> DataFrame:
    """Pages with missing measures: paper, page, venue, role and the measures (the view hole_ of the SQL)."""

    def measure(i: int, d: str) -> F.Column:
        value = F.when((F.col("role") == "A") & (F.col("page") % 2 == 0), 0.0).otherwise(F.col(d)) if d == "discount" else F.col(d)
        return F.when((F.col("paper") * 3 + F.col("page") * (i + 2)) % 11 >= MISSING[d], value).alias(d)

    return t.pages.select("paper", "page", "venue", "role", *[measure(i, d) for i, d in enumerate(MISSING)])


_DROPS = "miss_ AS (SELECT venue, role, dim, row_number() OVER (PARTITION BY venue, role ORDER BY miss DESC, i) AS turn FROM (" + " UNION ALL ".join(f"SELECT venue, role, '{d}' AS dim, {i} AS i, count(*) - count({d}) AS miss FROM hole_ GROUP BY 1, 2" for i, d in enumerate(DIMS)) + "))"
_COMPLETE = "try_ AS (" + " UNION ALL ".join(
    f"SELECT h.venue, h.role, {k} AS dropped, count(*) FILTER (WHERE " + " AND ".join(f"({d} IS NOT NULL OR t_{d} <= {k})" for d in DIMS) + ") AS complete FROM hole_ h JOIN turn_ USING (venue, role) GROUP BY 1, 2" for k in range(len(DIMS))
) + ")"
VALID = [
    HOLES, _DROPS, "turn_ AS (SELECT venue, role, " + ", ".join(f"max(turn) FILTER (WHERE dim = '{d}') AS t_{d}" for d in DIMS) + " FROM miss_ GROUP BY 1, 2)", _COMPLETE,
    f"keep_ AS (SELECT venue, role, min(dropped) AS dropped, arg_min(complete, dropped) AS complete FROM try_ WHERE complete >= {LEAST_PAGES} OR dropped = {len(DIMS) - 1} GROUP BY 1, 2)",
    f"kept_ AS (SELECT k.venue, k.role, m.dim, k.complete FROM keep_ k JOIN miss_ m ON m.venue = k.venue AND m.role = k.role AND m.turn > k.dropped WHERE k.complete >= {max(5, LEAST_PAGES // 4)})",
    "val_ AS (SELECT * FROM (UNPIVOT hole_ ON quantity, price, discount, tax, unit_price, net_price INTO NAME dim VALUE value))",
    "mode_ AS (SELECT venue, role, dim, sum(c) AS n, max(c) / sum(c) AS mode_share FROM (SELECT venue, role, dim, value, count(*) AS c FROM val_ GROUP BY ALL) GROUP BY 1, 2, 3)",
    "wide_ AS (SELECT venue, role, dim, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS width FROM (SELECT venue, role, dim, CASE WHEN dim IN ('price', 'net_price') THEN ln(1 + value) ELSE value END AS v FROM val_) GROUP BY 1, 2, 3)",
]


@query("dim_validity", with_views(PAGES_SQL, *VALID, body=f"SELECT venue, role, dim, complete, n::BIGINT AS n, round(mode_share, 6) AS mode_share, round(width, 6) AS width, CASE WHEN mode_share >= {dims.MOST_MODE} THEN 'mode' WHEN width <= 1e-9 THEN 'constant' END AS note FROM kept_ JOIN mode_ USING (venue, role, dim) JOIN wide_ USING (venue, role, dim)"))
def dim_validity(t: Tables) -> DataFrame:
    """Measures that a stratum keeps after the most-missing ones are dropped, and whether each is valid."""
    return dims.validity(holed(t), ["venue", "role"], DIMS, LEAST_PAGES, ("price", "net_price"))


@query("pca_profile")
def pca_profile(t: Tables) -> DataFrame:
    """Components of the complete pages with their six largest loadings."""
    return dims.components(holed(t), DIMS)


SELECT = [
    RANKS, SPEAR, HOLES, "e_ AS (SELECT role, a, b FROM spear_ WHERE abs(rho) >= 0.8 UNION ALL SELECT role, b, a FROM spear_ WHERE abs(rho) >= 0.8)", "fam_ AS (SELECT role, a AS dim, least(a, min(b)) AS family FROM e_ GROUP BY role, a)",
    "cov_ AS (" + " UNION ALL ".join(f"SELECT role, '{d}' AS dim, count({d}) / count(*) AS coverage FROM hole_ GROUP BY role" for d in DIMS) + ")",
    "ord_ AS (SELECT role, dim, family, grp, pref, row_number() OVER (PARTITION BY role ORDER BY pref, CASE WHEN pref < 2 THEN 0 ELSE -coverage END, dim) AS k FROM (SELECT c.role, c.dim, coverage, coalesce(family, 'alone:' || c.dim) AS family, CASE c.dim "
    + " ".join(f"WHEN '{d}' THEN '{g}'" for d, g in GROUPS.items()) + " ELSE c.dim END AS grp, CASE c.dim " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(PREFERRED)) + " ELSE 2 END AS pref FROM cov_ c LEFT JOIN fam_ f ON f.role = c.role AND f.dim = c.dim WHERE coverage >= 0.5))",
    """fold_ AS (SELECT role, 0 AS k, []::VARCHAR[] AS got, []::VARCHAR[] AS fams, []::VARCHAR[] AS grps FROM (SELECT DISTINCT role FROM ord_) UNION ALL
 SELECT role, k, CASE WHEN ok THEN list_append(got, dim) ELSE got END, CASE WHEN ok THEN list_append(fams, family) ELSE fams END, CASE WHEN ok THEN list_append(grps, grp) ELSE grps END
 FROM (SELECT o.*, got, fams, grps, NOT list_contains(fams, o.family) AND len(list_filter(grps, lambda g: g = o.grp)) < 2 AND (pref < 2 OR len(got) < 3) AS ok FROM fold_ f JOIN ord_ o ON o.role = f.role AND o.k = f.k + 1))""",
]


@query("select_dims", with_views("RECURSIVE " + PAGES_SQL.strip(), *SELECT, body="SELECT role, i AS rank, got[i] AS dim FROM (SELECT role, arg_max(got, k)[1:3] AS got FROM fold_ GROUP BY role), LATERAL (SELECT unnest(range(1, len(got) + 1)) AS i)"))
def select_dims(t: Tables) -> DataFrame:
    """At most three measures of each role: preferred ones first, one of a redundancy group, two of a metric group, half of the pages."""
    families = statistics.groups(statistics.spearman(t.pages, ["role"], DIMS, 50), ["role"], 0.8)
    member = families.select("role", F.col("grp").alias("family"), F.explode(F.split("members", ",")).alias("dim"))
    pages = holed(t)
    covered = pages.groupBy("role").agg(*[(F.count(d) / F.count("*")).alias(d) for d in DIMS]).unpivot("role", DIMS, "dim", "coverage")
    return dims.chosen(covered.join(member, ["role", "dim"], "left"), ["role"], PREFERRED, GROUPS, most=3)


@query("greedy_unique_pairs")
def greedy_unique_pairs(t: Tables) -> DataFrame:
    """Pairs of papers picked in turns of six groups, papers of one venue first, then by gap: each paper once, three a group, 15 in all."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = t["orders"].select((c % 6).alias("group"), c.alias("a"), (c + 1 + k % 50).alias("b"), F.when(k % 2 == 0, 0).otherwise(1).alias("other_venue"), (-F.round("o_totalprice", 2)).alias("less"))
    picked = matching.take_turns(rows, ["other_venue", "less"], 15)
    return picked.select(F.col("group").alias("dim"), "a", "b", (-F.col("less")).alias("gap"), (F.col("other_venue") == 0).alias("same_venue"), "turn", "place")
