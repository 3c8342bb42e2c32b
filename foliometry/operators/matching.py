"""Pairs picked in turns: groups take turns in a fixed order, each takes its best pair whose members are still free.

Only the next offer of each group reaches the driver, so it holds a row a group. Within a turn, offers stand as long as none
before them has taken a member; from the first one that has lost a member on, the groups make new offers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.operators.lineage import cut


def take_turns(candidates: DataFrame, order: list[str], pairs: int, quota: int = 3) -> DataFrame:
    """(group, a, b, and the columns of order) to the picked rows with turn and place (from 1, in the order of picking).

    Groups with fewer candidates go first (by name where equal). A group takes at most quota pairs, all together at most
    pairs; a member stands in one pair. Best is the smallest of the columns of order, then of a and b. It ends when no group
    that may go on has a free pair.
    """
    spark = candidates.sparkSession
    rows = cut(candidates.select("group", "a", "b", *order))
    groups = [r["group"] for r in rows.groupBy("group").agg(F.count("*").alias("n")).orderBy("n", "group").collect()]
    used: set = set()
    picked, left, turn = [], dict.fromkeys(groups, quota), 0
    best = F.min(F.struct(*order, "a", "b")).alias("p")
    while len(picked) < pairs:
        turn, moved = turn + 1, False
        waiting = [g for g in groups if left[g]]
        while waiting and len(picked) < pairs:
            free = rows.where(F.col("group").isin(waiting))
            if used:
                free = free.where(~F.col("a").isin(list(used)) & ~F.col("b").isin(list(used)))
            offers = {r["group"]: r["p"] for r in free.where("a <> b").groupBy("group").agg(best).collect()}
            taken: set = set()
            while waiting and len(picked) < pairs:
                offer = offers.get(waiting[0])
                if offer and {offer["a"], offer["b"]} & taken:
                    break  # this group must make another offer
                group = waiting.pop(0)
                if offer:
                    taken |= {offer["a"], offer["b"]}
                    left[group] -= 1
                    moved = True
                    picked.append((group, offer["a"], offer["b"], turn, len(picked) + 1))
            used |= taken
        if not moved:
            break
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    chosen = spark.createDataFrame(picked, f"group {kinds['group']}, a {kinds['a']}, b {kinds['b']}, turn long, place long")
    return rows.join(F.broadcast(chosen), ["group", "a", "b"]).groupBy("group", "a", "b", "turn", "place").agg(*[F.min(F.struct(*order))[c].alias(c) for c in order])
