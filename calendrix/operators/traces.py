"""The traces of the duplicate cascade: all candidates of an event as one sorted array.

Equal titles may be many for each event, so their pairs are never rows. Rows of both sides are dealt by slabs of time and shares of
titles, each once or twice; within a task the existing rows are sorted by title and start, an event's candidates are a few
runs of them, and its array is made, sorted and sent on in batches of about BATCH entries. What is shuffled and held grows with the rows, and
what other layers found comes along with the event, so that no array is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calendrix.functions.text import normal_title, normal_venue
from calendrix.operators.bands import HOUR, _arrow, _codes

SHARES, BATCH = 64, 500_000


def _keys(t: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of (t, at), and what to search them by; t below 0 is left out."""
    places = np.flatnonzero(t >= 0)
    value = t[places] * size + at[places]
    order = np.argsort(value, kind="stable")
    return places[order], value[order]


def _spread(low: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of each run, one run after the other."""
    return np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)


def _traced(near: int, far: int, schema: pa.Schema):
    """Answers a group's events from its existing rows; near and far are the bands of equal titles and of equal titles and venues."""

    def run(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        old = table["old"].to_numpy(zero_copy_only=False)
        a, b = table.filter(pa.array(~old)).combine_chunks(), table.filter(pa.array(old)).combine_chunks()
        b = b.take(pc.sort_indices(b, sort_keys=[("place", "ascending"), ("b_id", "ascending")], null_placement="at_start")).combine_chunks()
        n = len(a)
        if not n:
            return
        low, counts, runs = np.zeros((n, 3), np.int64), np.zeros((n, 3), np.int64), [np.empty(0, np.int64)] * 3
        if len(b):
            at, own = b["at"].to_numpy(), pc.fill_null(a["at"], 0).to_numpy()
            least, size = at.min(), int(at.max() - at.min()) + 2
            inside = lambda x: np.clip(x - least, 0, size - 1)
            titles, venues = pc.unique(b["t"]), pc.unique(b["v"].drop_null())
            t, v, own_t, own_v = _codes(b["t"], titles), _codes(b["v"], venues), _codes(a["t"], titles), _codes(a["v"], venues)
            own_t[pc.is_null(a["at"]).to_numpy(zero_copy_only=False)] = -1
            # Titles with venues are numbered by what b has of them.
            both = np.where(v >= 0, t * len(venues) + v, -1)
            known = np.unique(both)
            asked = np.where((own_t >= 0) & (own_v >= 0), own_t * len(venues) + own_v, -2)
            found = np.searchsorted(known, asked).clip(max=len(known) - 1)
            place_of = np.where(both >= 0, np.searchsorted(known, both), -1)
            asked = np.where((known[found] == asked) & (asked >= 0), found, -1)
            for i, (code, mine, start, stop) in enumerate((
                (t, own_t, own - near + 1, own + near),
                (place_of, asked, own - far + 1, own - near + 1),
                (place_of, asked, own + near, own + far),
            )):
                runs[i], value = _keys(code, at - least, size)
                ends = [np.searchsorted(value, mine * size + inside(x)) for x in (start, np.maximum(start, stop))]
                low[:, i], counts[:, i] = ends[0], np.where(mine >= 0, ends[1] - ends[0], 0)
        # Equal entries of rows with one id and place are one.
        code = np.cumsum(np.r_[True, _differs(b["place"]) | _differs(b["b_id"])])[: len(b)] - 1 if len(b) else np.empty(0, np.int64)
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(b) else code
        b_place, b_id = (b[c].combine_chunks().take(pa.array(first)) for c in ("place", "b_id"))
        more = a["more"].combine_chunks()
        size_of = pc.fill_null(pc.list_value_length(more), 0).to_numpy().astype(np.int64)
        total = np.cumsum(counts.sum(axis=1) + size_of)
        at_row = 0
        while at_row < n:
            done = total[at_row - 1] if at_row else 0
            stop = max(at_row + 1, int(np.searchsorted(total, done + BATCH, "right")))
            part, m = slice(at_row, stop), size_of[at_row:stop]
            held = [(np.repeat(np.arange(stop - at_row), counts[part, i]), code[runs[i][_spread(low[part, i], counts[part, i])]]) for i in range(3)]
            span = max(len(first), 1)
            entry = np.sort(np.concatenate([row * span + c for row, c in held]))
            entry = entry[np.r_[True, entry[1:] != entry[:-1]]] if len(entry) else entry
            row, c = entry // span, entry % span
            c1 = np.bincount(row, minlength=stop - at_row)
            offsets = np.r_[0, np.cumsum(c1 + m)]
            others = more.slice(at_row, stop - at_row).flatten()
            at1 = np.arange(len(c)) + (np.cumsum(m) - m)[row]
            at2 = np.arange(len(others)) + np.repeat(np.cumsum(c1), m)
            where = np.empty(len(c) + len(others), np.int64)
            where[at1], where[at2] = c, np.arange(len(others)) + len(first)
            layer = np.ones(len(where), np.int32)
            layer[at2] = pc.struct_field(others, "layer").to_numpy(zero_copy_only=False)
            place = pa.concat_arrays([b_place, pc.struct_field(others, "place")]).take(pa.array(where))
            match = pa.concat_arrays([b_id, pc.struct_field(others, "match_id").cast(b_id.type)]).take(pa.array(where))
            kind = schema.field("candidates").type
            none = pa.array(offsets[1:] == offsets[:-1])
            values = pa.StructArray.from_arrays([pa.array(layer), place, match], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=kind, mask=none)
            sure = pa.array(c1 > 0)
            head = match.take(pa.array(np.where(c1 > 0, offsets[:-1], None), pa.int64()))
            own_rows = a.slice(at_row, stop - at_row).combine_chunks()
            best = own_rows["best"].combine_chunks()
            chosen = pc.if_else(sure, head, pc.struct_field(best, "match_id").cast(b_id.type))
            at_layer = pc.if_else(sure, pa.scalar(1, pa.int32()), pc.struct_field(best, "layer"))
            yield pa.RecordBatch.from_arrays([own_rows["a_id"].combine_chunks(), chosen, at_layer, lists], schema=schema)
            at_row = stop

    return run


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first is another one than that before it; nulls are equal."""
    x, y = column.slice(1), column.slice(0, len(column) - 1)
    other = pc.fill_null(pc.not_equal(x, y), False).to_numpy()
    return other | (pc.is_null(x).to_numpy() != pc.is_null(y).to_numpy())


def traced(new: DataFrame, existing: DataFrame, others: DataFrame, hours: int = 12, venue_hours: int = 48) -> DataFrame:
    """(id, match_id, layer, candidates) of each new(id, title, start, venue): as layer 1 the existing(id, title, start, venue, arrival)
    of the same title within the hours, or of the same title and venue within venue_hours; then others(id, best, more, settled), sorted arrays of
    (layer, place, match_id) of other layers and the best of them. Events that are settled have no layer 1. Ids of new are unique."""
    near, far = (hours + 1) * HOUR, (venue_hours + 1) * HOUR
    slab = 2 * max(near, far)
    slab_of = lambda c: F.floor(c / slab).cast("long")
    title, venue, at = normal_title(F.col("title")), normal_venue(F.col("venue")), F.unix_micros("start")
    part = lambda df: df.withColumns({"t": F.when(title != "", title), "v": F.when(venue != "", venue), "at": at})
    arrival = "arrival" if "arrival" in existing.columns else "id"
    b = part(existing).where("t IS NOT NULL AND at IS NOT NULL").select("t", "v", "at", F.col("id").alias("b_id"), F.col(arrival).cast("double").alias("place"))
    b = b.withColumn("slab", F.explode(F.sequence(slab_of(F.col("at") - far), slab_of(F.col("at") + far))))
    a = part(new).select(F.col("id").alias("a_id"), "t", "v", "at").join(others.withColumnRenamed("id", "a_id").hint("merge"), "a_id", "left")
    a = a.withColumn("t", F.when(~F.coalesce("settled", F.lit(False)), F.col("t"))).withColumn("slab", slab_of(F.col("at"))).drop("settled")
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES))
    a = a.withColumn("share", F.when(F.col("t").isNull(), share(F.col("a_id"))).otherwise(share(F.col("t"))))
    both = a.withColumn("old", F.lit(False)).unionByName(b.withColumns({"old": F.lit(True), "share": share(F.col("t"))}), allowMissingColumns=True)
    id_, match = new.schema["id"].dataType.simpleString(), existing.schema["id"].dataType.simpleString()
    shape = f"id {id_}, match_id {match}, layer int, candidates array<struct<layer:int,place:double,match_id:{match}>>"
    run = _traced(near, far, _arrow(new.sparkSession, shape))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    return both.groupBy("slab", "share").applyInArrow(answer, shape)
