"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed mask names word offsets; the words between them are ignored, so a substituted word does not break the hit. Each
document position and each benchmark position is hashed under every mask; equal hashes are hits. Around a hit the two
texts are compared word by word along its diagonal, and the best ungapped stretch (match +1, mismatch -2) is kept
where it has at least min_matched equal words and at least min_identity percent of equal words.

Scale: a seed of the benchmark is a hash, an item and a position. Up to MOST_SEEDS of them (counted first) are broadcast:
documents are neither shuffled nor cut, positions are generated inside the scan's stage and probe the hashes there, and of a run of
hits on one diagonal the first only is compared, so a passage held by a third of all documents adds about one row per
document. A larger benchmark is joined by shuffle on the hash, hits are reduced to one row for each document, item and diagonal,
and the two texts join again only for these. Items' words join after the hits (Spark broadcasts them where their counted
number allows). Only verified (document, item) rows are grouped.

Defined results: words are runs outside ASCII punctuation, blanks and controls, A-Z lower-cased; a null or empty text has no
hits; an item of fewer than min_matched words counts where all its words stand together, one of fewer than SHORTEST words is
never reported; rows of an id or item count as one, with the best of their overlaps; a null id is an id of its own; an empty
table on either side gives an empty result; of equally good stretches the first in the document is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.llm.common import lower_ascii, without

#: Word offsets of each seed, by span; 1 to 4 positions between them are ignored. Some mask hits every passage of 12 words with 2
#: substitutions, 15 with 3 or 20 with 4 inside it (4,000 random ones tried).
MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 6, 8), (0, 2, 3, 4, 7, 9))
SPANS = tuple(mask[-1] + 1 for mask in MASKS)
SHORTEST = SPANS[0]
#: Rows of seeds, and words of items, that are broadcast (some 60 and 10 bytes each).
MOST_SEEDS, MOST_WORDS = 500_000, 4_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), NOT_WORD), "")


def _hashed(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    return df.select(key, F.transform(words(text), lambda w: F.xxhash64(w)).alias(name))


def _seeds(df: DataFrame, name: str, at: str) -> DataFrame:
    """A row for each position and mask, with the mask's hash."""
    spots = df.select("*", F.explode(F.when(F.size(name) >= SHORTEST, F.sequence(F.lit(0), F.size(name) - SHORTEST))).alias(at))
    seeds = [
        F.struct(F.lit(m).alias("mask"), F.when(F.col(at) + mask[-1] < F.size(name), F.xxhash64(F.lit(m), *[F.get(name, F.col(at) + o) for o in mask])).alias("hash"))
        for m, mask in enumerate(MASKS)
    ]
    return spots.select("*", F.explode(F.array(*seeds)).alias("seed")).select(*spots.columns, "seed.mask", "seed.hash").where(F.col("hash").isNotNull())


def _first_of_run() -> Column:
    """Not a hit that equal words one place before, or an earlier mask at the same place, give as well.

    Short on purpose: a long condition makes the generated method too large for the JIT compiler.
    """
    span = F.element_at(F.array(*map(F.lit, SPANS)), F.col("mask") + 1)
    before = F.when((F.col("p") > 0) & (F.col("q") > 0), F.slice("dw", F.col("p"), span) == F.slice("iw", F.col("q"), span)).otherwise(F.lit(False))
    earlier = (F.col("mask") > 0) & (F.slice("dw", F.col("p") + 1, SHORTEST) == F.slice("iw", F.col("q") + 1, SHORTEST))
    return ~before & ~earlier


def _best_stretch() -> Column:
    """The best ungapped stretch on the diagonal: matched, aligned, doc_start, item_start."""
    low = F.greatest(-F.col("p"), -F.col("q"))
    high = F.least(F.size("dw") - F.col("p"), F.size("iw") - F.col("q"))
    state = F.struct(*[F.lit(0).alias(n) for n in ("score", "start", "matched", "best", "best_start", "best_end", "best_matched")])

    def step(s: Column, k: Column) -> Column:
        same = F.get("dw", F.col("p") + k) == F.get("iw", F.col("q") + k)
        fresh = s["score"] <= 0
        score = F.when(fresh, 0).otherwise(s["score"]) + F.when(same, 1).otherwise(-2)
        start = F.when(fresh, k).otherwise(s["start"])
        matched = F.when(fresh, 0).otherwise(s["matched"]) + same.cast("int")
        better = score > s["best"]
        return F.struct(
            score.alias("score"), start.alias("start"), matched.alias("matched"),
            F.when(better, score).otherwise(s["best"]).alias("best"), F.when(better, start).otherwise(s["best_start"]).alias("best_start"),
            F.when(better, k + 1).otherwise(s["best_end"]).alias("best_end"), F.when(better, matched).otherwise(s["best_matched"]).alias("best_matched"),
        )

    return F.aggregate(
        F.sequence(low, high - 1), state, step,
        lambda s: F.struct(s["best_matched"].alias("matched"), (s["best_start"] - s["best_end"]).alias("minus_aligned"), (-(F.col("p") + s["best_start"])).alias("minus_start"), (F.col("q") + s["best_start"]).alias("item_start")),
    )


def leaks(docs: DataFrame, benchmark: DataFrame, min_matched: int = 10, min_identity: int = 80, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps: doc_id, item_id, n_matched, n_aligned, doc_start, item_start (word positions from 0)."""
    items = _hashed(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "item_id", "text", "iw")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    item_seeds = _seeds(items, "iw", "q").select("hash", "item_id", "q")
    n, n_words = item_seeds.count(), items.agg(F.sum(F.size("iw"))).first()[0] or 0
    items = (F.broadcast if n_words <= MOST_WORDS else lambda df: df)(items.withColumnRenamed("item_id", "own_item"))
    own = F.col("item_id").eqNullSafe(F.col("own_item"))
    if n <= MOST_SEEDS:
        doc_seeds = _seeds(_hashed(docs, "doc_id", "text", "dw"), "dw", "p")
        hits = doc_seeds.join(F.broadcast(item_seeds), "hash").join(items, own).where(_first_of_run())
    else:
        key = ["doc_id", "t"]  # rows that share an id are told apart by their text
        rows = docs.withColumn("t", F.xxhash64("text"))
        rows = rows.select(*key, F.transform(words("text"), lambda w: F.xxhash64(w)).alias("dw"))
        met = _seeds(rows, "dw", "p").select(*key, "p", "hash").join(item_seeds, "hash").groupBy(*key, "item_id", (F.col("p") - F.col("q")).alias("shift")).agg(F.min("p").alias("p"))
        met = met.withColumn("q", F.col("p") - F.col("shift")).withColumnsRenamed({"doc_id": "d", "t": "u"})
        hits = rows.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u"))).drop("d", "u").join(items, own)
    found = hits.select("doc_id", "item_id", F.least(F.lit(min_matched), F.size("iw")).alias("need"), _best_stretch().alias("s"))
    # the test stands inside the aggregate: as a filter it would move into the join and take it out of generated code
    holds = (F.col("s.matched") >= F.col("need")) & (100 * F.col("s.matched") >= -min_identity * F.col("s.minus_aligned"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.when(holds, F.col("s"))).alias("s")).where(F.col("s").isNotNull())
    return best.select(
        "doc_id", "item_id", F.col("s.matched").cast("long").alias("n_matched"), (-F.col("s.minus_aligned")).cast("long").alias("n_aligned"),
        (-F.col("s.minus_start")).cast("long").alias("doc_start"), F.col("s.item_start").cast("long").alias("item_start"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """docs without the rows whose text holds a passage of the benchmark; texts are told apart by hash, ids play no part."""
    key = F.xxhash64(text)
    gone = leaks(docs.select(key.alias("doc_id"), F.col(text).alias("text")), benchmark, **how).select("doc_id").distinct()
    return without(docs, gone, key)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)


def _sql() -> str:
    cols = ", ".join(f"CASE WHEN q + {m[-1]} <= len(ws) THEN '{k}|' || {" || ' ' || ".join(f'ws[q + {o}]' for o in m)} END" for k, m in enumerate(MASKS))
    toks = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, {toks} AS ws FROM documents), b AS MATERIALIZED (SELECT DISTINCT item_id, {toks} AS ws FROM benchmark),
ds AS (SELECT doc_id, q AS p, unnest([{cols}]) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SHORTEST - 2})) AS q FROM d WHERE len(ws) >= {SHORTEST})),
bs AS (SELECT item_id, q, unnest([{cols}]) AS h FROM (SELECT item_id, ws, unnest(range(1, len(ws) - {SHORTEST - 2})) AS q FROM b WHERE len(ws) >= {SHORTEST})),
diag AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, p - q AS shift FROM ds JOIN bs USING (h) WHERE h IS NOT NULL),
cell AS (SELECT g.doc_id, g.item_id, g.shift, i, (d.ws[i + g.shift] = b.ws[i]) AS same
         FROM diag g JOIN d USING (doc_id) JOIN (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM b) b USING (item_id)
         WHERE i + g.shift BETWEEN 1 AND len(d.ws)),
pre AS MATERIALIZED (SELECT *, sum(CASE WHEN same THEN 1 ELSE -2 END) OVER w AS s, sum(same::INT) OVER w AS m FROM cell WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY i)),
seg AS (SELECT e.doc_id, e.item_id, e.shift, e.s - (f.s - CASE WHEN f.same THEN 1 ELSE -2 END) AS score, e.m - f.m + f.same::INT AS matched, e.i - f.i + 1 AS aligned, f.i AS item_from, e.i AS item_to
        FROM pre f JOIN pre e ON f.doc_id = e.doc_id AND f.item_id = e.item_id AND f.shift = e.shift AND e.i >= f.i),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY score DESC, item_to, item_from DESC) AS r FROM seg),
held AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, aligned, item_from + shift, item_from DESC) AS k FROM best JOIN (SELECT item_id, len(ws) AS n_words FROM b) USING (item_id)
         WHERE r = 1 AND matched >= least(10, n_words) AND 100 * matched >= 80 * aligned)
SELECT doc_id, item_id, matched::BIGINT AS n_matched, aligned::BIGINT AS n_aligned, (item_from + shift - 1)::BIGINT AS doc_start, (item_from - 1)::BIGINT AS item_start FROM held WHERE k = 1
"""


SQL = _sql()
