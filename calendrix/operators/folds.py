"""Folds of ordered steps over a few states, in parallel within a key.

Each step is a map from states to states, and maps compose: whatever the state before a run of steps is,
its effect is one small map. Steps are dealt by ranges of (key, order), so a key with most of the rows
spans many tasks; each task composes the maps of its part of a key, the parts' maps are applied one after
the other, one row for each part, and every step then knows the state that it met.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calendrix.operators.kept import checkpointed


def _composed(moves: dict[str, tuple[int, ...]], states: int):
    """For rows sorted by key and order: each with the map of its part of the key up to it, and the part."""
    nothing = tuple(range(states))

    def run(batches):
        now, at, part = None, nothing, -1
        base = TaskContext.get().partitionId() << 33
        for pdf in batches:
            before, after, parts = [], [], []
            for key, step in zip(pdf["key"], pdf["step"]):
                if part < 0 or key != now:
                    now, at, part = key, nothing, part + 1
                before.append(list(at))
                move = moves.get(step, nothing)
                at = tuple(move[s] for s in at)
                after.append(list(at))
                parts.append(base + part)
            yield pdf.assign(before=before, after=after, part=parts)

    return run


def folded(steps: DataFrame, order: list[str], moves: dict[str, tuple[int, ...]], start: DataFrame, states: int) -> tuple[DataFrame, DataFrame]:
    """steps(key, step, order...) with state_before and state_after of each, and (key, state) after all steps
    of every key of start(key, state) or steps; keys that start has not begin in state 0.

    Steps that moves does not name change nothing. Rows equal in key and order are taken in any order; null
    keys have no state and are left out.
    """
    checkpointed(steps.sparkSession)
    rows = steps.where("key IS NOT NULL")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", before array<int>, after array<int>, part bigint"
    sorted_ = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = sorted_.mapInPandas(_composed(moves, states), shape).checkpoint()
    # One row for each part of a key, of which there are as many as tasks that it spans.
    ends = placed.groupBy("key", "part").agg(F.max_by("after", F.struct(*order)).alias("map"))
    begin = start.where("key IS NOT NULL").groupBy("key").agg(F.max("state").alias("first"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    through = lambda maps: F.aggregate(maps, F.coalesce("first", F.lit(0)), lambda state, m: F.get(m, state))
    parts = ends.join(begin, "key", "left").withColumn("maps", F.collect_list("map").over(earlier)).withColumn("state", through(F.col("maps"))).checkpoint()
    met = placed.join(parts.select("key", "part", "state"), ["key", "part"])
    out = met.select(*rows.columns, F.get("before", F.col("state")).alias("state_before"), F.get("after", F.col("state")).alias("state_after"))
    last = parts.groupBy("key").agg(F.max_by(F.get("map", F.col("state")), "part").alias("end"))
    final = begin.join(last, "key", "full").select("key", F.coalesce("end", "first", F.lit(0)).alias("state"))
    return out, final
