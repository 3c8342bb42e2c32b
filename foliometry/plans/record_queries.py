"""Queries of requests: events as actions with parameters, checked against a rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.operators import records
from foliometry.plans.registry import Tables, query, with_views

RULE_ROWS = [
    ("click", "k", "int", True, None, 3.0, 40.0, None, None), ("click", "v", "float", False, "5", 1.0, 60.0, None, None), ("click", "flag", "bool", False, "false", None, None, None, None),
    ("view", "k", "int", False, None, None, 30.0, None, None), ("view", "mode", "text", True, None, None, None, "^[a-z]+$", 4), ("purchase", "v", "float", True, None, 10.0, None, None, None),
    ("signup", None, None, None, None, None, None, None, None),
]
#: Expressions of the stand-in parameters, read alike by both engines.
PARAMS = {
    "k": "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '1.5' WHEN event_type = 'click' OR event_id % 3 = 0 THEN CAST(event_id % 50 AS STRING) END",
    "v": "CASE WHEN event_type IN ('click', 'purchase') AND event_id % 5 <> 0 THEN CASE WHEN event_id % 11 = 0 THEN 'many' ELSE CAST(event_id % 80 AS STRING) || '.5' END END",
    "flag": "CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN ' TRUE' ELSE 'yes' END END",
    "mode": "CASE WHEN event_type = 'view' THEN CASE event_id % 4 WHEN 0 THEN 'abc ' WHEN 1 THEN 'abcde' WHEN 2 THEN 'A1' END END",
}
_shown = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
RULE_SQL = "rule_(action, param, type, required, deflt, lo, hi, pattern, longest) AS (VALUES " + ", ".join("(" + ", ".join(map(_shown, r)) + ")" for r in RULE_ROWS) + ")"
GIVEN_SQL = "p_ AS (SELECT event_id, event_type AS action, param, value, trim(value) AS t FROM (" + " UNION ALL ".join(f"SELECT event_id, event_type, '{k}' AS param, {e} AS value FROM events" for k, e in PARAMS.items()) + ") WHERE value IS NOT NULL)"
CHECK_SQL = r"""
n_ AS (SELECT p_.*, r.* EXCLUDE (action, param), CASE WHEN type = 'int' AND regexp_full_match(t, '[+-]?[0-9]+') OR type = 'float' THEN TRY_CAST(t AS DOUBLE) END AS x
  FROM p_ JOIN rule_ r ON r.action = p_.action AND r.param = p_.param),
c_ AS (SELECT event_id, action, param, CASE WHEN type = 'bool' THEN lower(t) ELSE t END AS clean,
    CASE WHEN type IN ('int', 'float') AND x IS NULL THEN 'needs ' || type WHEN x < lo THEN 'below range' WHEN x > hi THEN 'above range' WHEN type = 'bool' AND lower(t) NOT IN ('true', 'false') THEN 'needs bool'
      WHEN type = 'text' AND length(value) > longest THEN 'too long' WHEN type = 'text' AND NOT regexp_matches(t, pattern) THEN 'bad format' END AS error FROM n_),
m_ AS (SELECT event_id, r.param, r.deflt, r.required FROM events JOIN rule_ r ON r.action = event_type AND r.param IS NOT NULL LEFT JOIN p_ USING (event_id, param) WHERE p_.value IS NULL),
e_ AS (SELECT event_id, 'unknown action' AS e FROM events WHERE event_type NOT IN (SELECT action FROM rule_)
  UNION ALL SELECT event_id, param || ': unknown' FROM p_ WHERE action IN (SELECT action FROM rule_) AND NOT EXISTS (SELECT 1 FROM rule_ r WHERE r.action = p_.action AND r.param = p_.param)
  UNION ALL SELECT event_id, param || ': missing' FROM m_ WHERE required UNION ALL SELECT event_id, param || ': ' || error FROM c_ WHERE error IS NOT NULL),
k_ AS (SELECT event_id, param, clean FROM c_ WHERE error IS NULL UNION ALL SELECT event_id, param, deflt FROM m_ WHERE deflt IS NOT NULL)"""


@query("record_validate", with_views(RULE_SQL, GIVEN_SQL, CHECK_SQL, body="""SELECT event_id, e.l IS NULL AS ok, coalesce(e.l, '') AS errors, coalesce(k.l, '') AS clean FROM events
LEFT JOIN (SELECT event_id, string_agg(e, '; ' ORDER BY e) AS l FROM e_ GROUP BY 1) e USING (event_id) LEFT JOIN (SELECT event_id, string_agg(param || '=' || clean, ';' ORDER BY param) AS l FROM k_ GROUP BY 1) k USING (event_id)"""))  # fmt: skip
def record_validate(t: Tables) -> DataFrame:
    """Events as requests: unknown actions and parameters, missing ones, types, ranges, formats, defaults."""
    given = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.expr(e)) for k, e in PARAMS.items()]))
    rows = t["events"].select("event_id", F.col("event_type").alias("action"), F.map_filter(given, lambda k, v: v.isNotNull()).alias("params"))
    out = records.validated(rows, t.spark.createDataFrame(RULE_ROWS, records.RULES))
    pairs = F.transform(F.array_sort(F.map_keys("clean")), lambda k: F.concat_ws("=", k, F.element_at("clean", k)))
    return out.select("event_id", "ok", F.array_join("errors", "; ").alias("errors"), F.array_join(pairs, ";").alias("clean"))
