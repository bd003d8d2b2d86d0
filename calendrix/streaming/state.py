"""Streams with state: the rate limit and the scrape counters of transitions, event by event.

Both keep a small state for each key and take a key's rows in order of their time: rows wait in the
state until the watermark has passed them, when a timer lets them out in order. So a stream decides as the batch
does, whatever the order of arrival, for all rows that are not later than the watermark; those are dropped by
Spark. A key's state goes when a timer finds nothing left that could matter. The session's state store must be RocksDB's
(spark.sql.streaming.stateStore.providerClass), as Spark asks of all such processors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

HOUR_MS = 3_600_000


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them; a subclass says what a row does to the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", StructType([StructField("micros", LongType()), StructField("id", LongType())]), StructType([StructField("kind", StringType())]))
        self.kept = handle.getValueState("kept", StructType([StructField("values", ArrayType(LongType()))]))

    def values(self) -> list[int]:
        return list(self.kept.get()[0]) if self.kept.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for micros, number, kind in zip(pdf["micros"], pdf["id"], pdf["kind"]):
                self.waiting.updateValue((int(micros), int(number)), (None if pd.isna(kind) else str(kind),))
                # Due as soon as no earlier row can come.
                self.handle.registerTimer(int(micros) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] <= due)
        state, out = self.values(), []
        for micros, number, kind in rows:
            self.waiting.removeKey((micros, number))
            state = self.step(state, micros, number, kind, out)
        if state is None or not self.keeps(state, due):
            self.kept.clear()
        else:
            self.kept.update((state,))
            self.handle.registerTimer(int(due // 1000) + self.lasts())
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=self.columns)

    def close(self) -> None:
        pass


def _limiter(most: int, hours: int) -> StatefulProcessor:
    width = hours * HOUR_MS * 1000

    class Limiter(_InOrder):
        columns = ("key", "request_id", "accepted")

        def step(self, state, micros, number, kind, out):
            state = [x for x in state if micros - x < width]
            out.append((number, len(state) < most))
            return [*state, micros] if len(state) < most else state

        def keeps(self, state, due):
            return any(due - x < width for x in state)

        def lasts(self):
            return hours * HOUR_MS

    return Limiter()


def _rows(stream: DataFrame, key: str, number: str, at: str, kind, late: str) -> DataFrame:
    return stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late).select(
        F.col(key).cast("string").alias("key"), F.col(number).cast("long").alias("id"), F.unix_micros(at).alias("micros"), kind.alias("kind"), F.col(at).alias("at")
    )


def rate_limited(requests: DataFrame, key: str, most: int = 3, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """(key, request_id, accepted) of a stream requests(request_id, key, at), as transitions.rate_limited()
    decides them. Requests without a key or a time are left out."""
    rows = _rows(requests, key, "request_id", "at", F.lit(None).cast("string"), late)
    return rows.groupBy("key").transformWithStateInPandas(_limiter(most, hours), "key string, request_id long, accepted boolean", "append", "EventTime")


def _counter(quiet_days: int) -> StatefulProcessor:
    class Counter(_InOrder):
        columns = ("source", "run_id", "fetch_failures", "parse_failures", "empty_scrapes", "events_found")

        def step(self, state, micros, number, kind, out):
            events, what = kind.split(":")
            fetch, parse, empty, found, _ = state or [0] * 5
            if int(events):
                fetch = parse = empty = 0
            else:
                fetch, parse, empty = fetch + (what == "fetch"), parse + (what == "parse"), empty + (what == "empty")
            out.append((number, fetch, parse, empty, found + int(events)))
            return [fetch, parse, empty, found + int(events), micros]

        def keeps(self, state, due):
            return bool(state) and due - state[4] < quiet_days * 24 * HOUR_MS * 1000

        def lasts(self):
            return quiet_days * 24 * HOUR_MS

    return Counter()


def scrape_counters(runs: DataFrame, late: str = "1 hour", quiet_days: int = 365) -> DataFrame:
    """A row for each run of a stream runs(run_id, source, at, events, status, http_status, keywords) with its
    source's counters after it, as transitions.scrape_counters() has them after the last. A source that
    had no run for quiet_days starts anew."""
    parse = (F.col("status") == "parse_uncertain") | (F.col("keywords") & (F.col("http_status") == 200))
    what = F.when(F.col("status") == "fetch_failed", "fetch").when(F.coalesce(parse, F.lit(False)), "parse").otherwise("empty")
    kind = F.concat(F.coalesce("events", F.lit(0)).cast("string"), F.lit(":"), what)
    rows = _rows(runs, "source", "run_id", "at", kind, late)
    shape = "source string, run_id long, fetch_failures long, parse_failures long, empty_scrapes long, events_found long"
    return rows.groupBy("key").transformWithStateInPandas(_counter(quiet_days), shape, "append", "EventTime")
