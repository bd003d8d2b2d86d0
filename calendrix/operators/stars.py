"""Greedy groups of events by a sweep over time, without a table of pairs.

In order of (start, id), an event that is in no group heads a new one and takes all later events alike to
it that are in none. Two events are alike if they have a likeness of some kind: names that are near each other, and
starts within the kind's whole hours. So an event's fate depends on heads only, and on few of them: of
one name at most one head lies within the hours, as the later would be in the earlier one's group. A sweep
needs the last head of each name near the event's own, and nothing of the other events.

Events are dealt by ranges of (start, id) into slabs of about SLAB rows, which are swept in parallel. In a slab,
events with the same names are one row with their times in order: until the hours of the heads near them have passed
none of them can be a head, so a sweep goes from head to head and skips what lies between. What
goes from slab to slab are the heads whose hours reach into it. Slabs are swept anew until no slab's heads
from before change: the first slab is right at once, and each slab is when those it is reached from are. Groups
seldom reach far, so few rounds are needed; after EAGER rounds only the first slab that is not yet settled
is swept, which bounds the work even where one chain runs through all of time. The rounds make heads only; once these are
settled, one more sweep gives every event its head.

The names near a name are one list, which each slab gets once: it grows with the different names that are alike, not with the
events. Events without a start or an id are in no group; of repeated ids each row is swept, and the first of them
decides. An empty table has no groups.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.functions.semantics import or_else
from calendrix.functions.text import venue_fingerprints
from calendrix.operators.dedup import GRAM, overlapping_venues, with_places
from calendrix.operators.fuzzy import close_strings
from calendrix.operators.kept import checkpointed
from calendrix.operators.selection import top_of_each

SLAB, EAGER = 1_000_000, 8
HOUR = 3_600_000_000  # microseconds


@dataclass
class Likeness:
    """A kind of likeness: name is the event's own (null: none), near are all names near it, its own
    included (null: its own alone)."""

    name: Column
    hours: int
    near: DataFrame | None = None  # (name, other), both ways


class _Slab:
    """One slab while it is swept: events(names, at, ids), at and ids in order, after what it is given: the heads(id, at,
    names) that reach into it, and (kind, name, near) of its names."""

    def __init__(self, reach: list[int], events: pd.DataFrame, given: pd.DataFrame):
        self.reach = reach
        self.rows = [(tuple(names), at, ids) for names, at, ids in events[["names", "at", "ids"]].itertuples(index=False)]
        listed = given[given["name"].notna()]
        near = {(int(kind), name): others for kind, name, others in listed[["kind", "name", "near"]].itertuples(index=False)}
        #: By kind and a head's name, the names of the slab that it is near to.
        self.of = defaultdict(list)
        for kind, name in {(kind, name) for names, _, _ in self.rows for kind, name in enumerate(names) if name is not None}:
            for other in near.get((kind, name), (name,)):
                self.of[kind, other].append((kind, name))
        #: By kind and name, the times and ids of the heads near it, in order.
        self.heads: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
        self.until: dict[tuple, int] = {}
        before = given[given["name"].isna()].sort_values(["at", "id"])
        for event, at, names in before[["id", "at", "names"]].itertuples(index=False):
            self.keep(at, event, names)

    def keep(self, at, event, names: Iterable) -> None:
        for kind, name in enumerate(names):
            for own in self.of.get((kind, name), ()) if name is not None else ():
                times, ids = self.heads[own]
                times.append(at)
                ids.append(event)
                self.until[own] = at + self.reach[kind]

    def sweep(self) -> Iterator[tuple]:
        """The slab's heads (at, id, names) in order."""
        ends = lambda names: max((self.until.get(own, -(2**63)) for own in enumerate(names)), default=-(2**63))
        waiting = [(at[0], ids[0], n, 0) for n, (_, at, ids) in enumerate(self.rows)]
        heapq.heapify(waiting)
        while waiting:
            moment, event, n, place = heapq.heappop(waiting)
            names, at, ids = self.rows[n]
            end = ends(names)
            if end <= moment:
                self.keep(moment, event, names)
                yield moment, event, names
                end, place = ends(names), place + 1
            # Its next event that the heads so far do not take.
            place = max(place, int(np.searchsorted(at, end)))
            if place < len(at):
                heapq.heappush(waiting, (at[place], ids[place], n, place))

    def members(self) -> Iterator[tuple]:
        """(ids, heads): of each row, after the sweep, its events and of each the first head whose hours reach it."""
        for names, at, ids in self.rows:
            met = []
            for own in enumerate(names):
                if own in self.heads:
                    times, events = self.heads[own]
                    some = range(bisect_right(times, at[0] - self.reach[own[0]]), bisect_right(times, at[-1]))
                    met += [(times[i], events[i], times[i] + self.reach[own[0]]) for i in some]
            met.sort()
            latest = np.maximum.accumulate(np.array([end for _, _, end in met], dtype="int64"))
            first = np.searchsorted(latest, at, side="right")
            yield ids, np.array([event for _, event, _ in met], dtype=ids.dtype)[first]


def _heads(reach: list[int]):
    """(slab, id, at, names) of the heads of a slab."""

    def run(key, events: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = [(key[0], event, at, list(names)) for at, event, names in _Slab(reach, events, given).sweep()]
        return pd.DataFrame(out, columns=["slab", "id", "at", "names"])

    return run


def _members(reach: list[int]):
    """(id, head) of the events of a slab."""

    def run(key, events: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        slab = _Slab(reach, events, given)
        for _ in slab.sweep():
            pass
        ids, heads = zip(*slab.members()) if slab.rows else ([[]], [[]])
        return pd.DataFrame({"id": np.concatenate(ids), "head": np.concatenate(heads)})

    return run


def _reaching(heads: DataFrame, slabs: DataFrame, reach: int) -> DataFrame:
    """heads(slab, id, at, names) once for each later slab that their hours reach into."""
    into = slabs.select(F.col("slab").alias("to"), "low")  # one row for each slab
    met = heads.join(F.broadcast(into), (F.col("to") > F.col("slab")) & (F.col("low") - F.col("at") < reach))
    return met.select(F.col("to").alias("slab"), "id", "at", "names")


def star_groups(events: DataFrame, kinds: list[Likeness], slab: int = SLAB, eager: int = EAGER) -> DataFrame:
    """(id, head) of events(id, start, ...) in groups of two or more; the head is the earliest member."""
    checkpointed(events.sparkSession)
    rows = events.where("start IS NOT NULL AND id IS NOT NULL")
    names = F.array(*[k.name.cast("string") for k in kinds])
    rows = rows.select("id", F.unix_micros(F.col("start").cast("timestamp")).alias("at"), names.alias("names"))
    rows = rows.checkpoint()
    count = rows.count()
    if not count:
        return rows.select("id", F.col("id").alias("head"))
    dealt = rows.repartitionByRange(max(1, -(-count // slab)), "at", "id").withColumn("slab", F.spark_partition_id()).checkpoint()
    slabs = dealt.groupBy("slab").agg(F.min("at").alias("low")).checkpoint()
    order = [r.slab for r in slabs.orderBy("slab").collect()]  # one number for each slab
    reach = [(k.hours + 1) * HOUR for k in kinds]
    kind = dealt.schema["id"].dataType.simpleString()
    used = dealt.select("slab", F.posexplode("names").alias("kind", "name")).where("name IS NOT NULL").distinct()
    lists = dealt.sparkSession.createDataFrame([], "kind int, name string, near array<string>")
    for n, one in enumerate(kinds):
        if one.near is not None:
            lists = lists.unionByName(one.near.groupBy("name").agg(F.collect_set("other").alias("near")).withColumn("kind", F.lit(n)))
    none = lambda of: F.lit(None).cast(of)
    # Without nulls in number columns, which pandas would take as floats.
    zero = F.lit(0)
    listed = used.join(lists, ["kind", "name"]).select("slab", zero.cast(kind).alias("id"), zero.cast("bigint").alias("at"), none("array<string>").alias("names"), "kind", "name", "near").checkpoint()
    alike = dealt.groupBy("slab", "names").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("all"))  # a slab's rows at most
    packed = alike.select("slab", "names", F.col("all.at").alias("at"), F.col("all.id").alias("ids")).checkpoint()

    def swept(numbers: list[int], heads: DataFrame, run, shape: str) -> DataFrame:
        asked = F.col("slab").isin(numbers)
        given = heads.select("*", none("int").alias("kind"), none("string").alias("name"), none("array<string>").alias("near")).unionByName(listed)
        return packed.where(asked).groupBy("slab").cogroup(given.where(asked).groupBy("slab")).applyInPandas(lambda key, a, b: run(key, a, b), shape)

    def heads_of(numbers: list[int], heads: DataFrame) -> DataFrame:
        return swept(numbers, heads, _heads(reach), f"slab int, id {kind}, at bigint, names array<string>")

    def marks(heads: DataFrame) -> dict[int, tuple]:
        """What tells whether the heads that reach a slab have changed; one row for each slab."""
        sums = heads.groupBy("slab").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id", "at")).alias("x"), F.bit_xor(F.xxhash64("at", "id")).alias("y"))
        return {r.slab: (r.n, r.x, r.y) for r in sums.collect()}

    done = heads_of(order, dealt.select("slab", "id", "at", "names").limit(0)).checkpoint()
    known: dict[int, tuple] = {}
    rounds = 0
    while True:
        heads = _reaching(done, slabs, max(reach)).checkpoint()
        now = marks(heads)
        changed = [s for s in order if now.get(s) != known.get(s)]
        if not changed:
            return _of_two(swept(order, heads, _members(reach), f"id {kind}, head {kind}").checkpoint())
        if rounds >= eager:
            changed = changed[:1]
        rounds += 1
        known |= {s: now.get(s) for s in changed}
        done = done.where(~F.col("slab").isin(changed)).union(heads_of(changed, heads)).checkpoint()


def _of_two(done: DataFrame) -> DataFrame:
    sizes = done.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head")
    return done.select("id", "head").join(sizes, "head", "left_semi").select("id", "head")


def reconciler_kinds(events: DataFrame, threshold: float = 0.45, title_hours: int = 48, venue_hours: int = 3, bare_hours: int = 1) -> tuple[DataFrame, list[Likeness]]:
    """events with the columns that the reconciler's kinds of likeness name: close titles within two
    days, overlapping venues within three hours, and no venue on either side within one."""
    placed = with_places(events)
    prints = venue_fingerprints(F.col("venue"), F.col("address"), GRAM)
    bare = or_else(F.col("venue"), F.col("address")).isNull()
    rows = placed.select("id", "start", F.lower("title").alias("title"), prints.alias("prints"), F.when(bare, "bare").alias("bare"))
    rows = rows.withColumn("k", F.when(F.size("prints") > 0, F.array_join("prints", "|")))
    bucket = F.floor(F.unix_seconds("start") / ((title_hours + 1) * 3600))
    timed = rows.where("start IS NOT NULL")
    left = timed.select(F.col("title").alias("s"), bucket.alias("bucket"))
    right = timed.select(F.col("title").alias("s"), F.explode(F.array(*[bucket + n for n in (-1, 0, 1)])).alias("bucket"))
    titles = close_strings(left, right, threshold, ("bucket",)).select(F.col("a").alias("name"), F.col("b").alias("other"))
    venues = overlapping_venues(timed, timed).toDF("name", "other")
    kinds = [Likeness(F.col("title"), title_hours, titles), Likeness(F.col("k"), venue_hours, venues), Likeness(F.col("bare"), bare_hours)]
    return rows, kinds


def groups(events: DataFrame, **settings) -> DataFrame:
    """(id, head): the reconciler's groups of events(id, start, title, venue, address, and location if there is one)."""
    limits = {k: settings.pop(k) for k in ("slab", "eager") if k in settings}
    rows, kinds = reconciler_kinds(events, **settings)
    return star_groups(rows, kinds, **limits)


def first_groups(members: DataFrame, events: DataFrame, most: int = 50) -> DataFrame:
    """(head, rank, size, ids): the first `most` of the groups (id, head) by their heads' start, with their
    members by start. Only the heads are ordered, and only the groups taken are gathered."""
    at = events.select("id", "start")
    heads = members.select("head").distinct().join(at, F.col("head") == F.col("id")).select("head", "start")
    first = heads.orderBy("start", "head").limit(most).withColumn("all", F.lit(0))
    first = top_of_each(first, ["all"], ["start", "head"], most).select("head", "rank")
    own = members.join(F.broadcast(first), "head").join(at, "id")  # `most` rows
    listed = own.groupBy("head", "rank").agg(F.sort_array(F.collect_list(F.struct("start", "id"))).alias("m"))
    return listed.select("head", "rank", F.size("m").alias("size"), F.transform("m", lambda x: x["id"]).alias("ids"))
