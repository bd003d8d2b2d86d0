"""Embedding whitening: principal components by hierarchical merging of singular value decompositions.

Each task folds its vectors, a chunk at a time, into a summary of their count, exact sums, mean and all
singular values and right vectors of the centred rows. Two summaries merge by stacking
diag(s1) V1, diag(s2) V2 and the row sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), which corrects for the
two means, and decomposing the stack again: no dimension is ever cut, so the result is the
decomposition of all rows. Summaries meet FAN at a time on executors until one is left; the
covariance matrix itself is never formed, whose small eigenvalues would lose half their digits.

A fit takes each distinct vector once, so a vector with a third of all rows weighs as one and is reduced
before the shuffle. Entries become whole numbers floor(64 c) + 1000000 first, so that equal vectors
are equal exactly and their sums are exact.

Rows whose vector is null or has null or non-finite entries are left out. Vectors of unlike lengths are of
unlike spaces: each length has a fit of its own. Empty vectors have no components. A component
without variance (below TINY of the greatest) whitens to 0 and has no part in the identity error. Scaled entries beyond
MOST count as MOST, so that sums stay whole; a deviation too large for 38 digits is null.
Repeated rows and null ids each keep a row; further columns of any name are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.llm.common import durable, sent, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows decomposed at a time, and summaries that one task merges.
CHUNK, FAN = 4096, 16
#: Of the greatest eigenvalue; below it a component is rounding alone.
TINY = 1e-22
MOST = 1 << 50


def whole(entries: Column | str, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """The array as whole numbers, null where it is null or holds a null, infinite or NaN entry."""
    entries = F.col(entries) if isinstance(entries, str) else entries
    wide = F.transform(entries, lambda c: c.cast("double"))
    finite = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(entries.isNotNull() & finite, F.transform(wide, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST)))) + offset))


# -- summaries --------------------------------------------------------------------------------------


@dataclass
class Summary:
    """n rows of sums (exact), and r with r'r the scatter about their mean: all singular values by their vectors."""

    n: int
    sums: np.ndarray
    r: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        sums = np.array([int(c) for c in x.sum(axis=0)], object)
        # About a whole number first, so that the differences are exact.
        near = np.array([s // len(x) for s in sums], np.int64)
        d = (x - near).astype(float)
        return Summary(len(x), sums, _decomposed(d - (d.sum(axis=0) / len(x))))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        # mean1 - mean2 as one quotient of exact whole numbers
        gap = np.array([float(a * other.n - b * self.n) for a, b in zip(self.sums, other.sums)]) / (self.n * other.n)
        row = np.sqrt(self.n * other.n / n) * gap
        return Summary(n, self.sums + other.sums, _decomposed(np.vstack([self.r, other.r, row])))

    def packed(self) -> dict:
        return {"n": self.n, "sums": [str(s) for s in self.sums], "r": self.r.ravel().tolist()}

    @staticmethod
    def unpacked(n: int, sums: list[str], r: list[float]) -> Summary:
        return Summary(n, np.array([int(s) for s in sums], object), np.asarray(r, float).reshape(-1, len(sums)))


def _decomposed(rows: np.ndarray) -> np.ndarray:
    """diag(s) V of the rows: at most as many rows as columns, with the same scatter."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


_SUMMARY = "dim int, node bigint, n bigint, sums array<string>, r array<double>"


def _emit(found: dict[int, Summary], node: int) -> pa.RecordBatch:
    rows = [{"dim": dim, "node": node, **s.packed()} for dim, s in found.items()]
    kinds = pa.schema([("dim", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("r", pa.list_(pa.float64()))])
    return pa.RecordBatch.from_pylist(rows, kinds)


def matrices(column: pa.ListArray):
    """(positions, rows as a matrix) for each length of the list."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, values[offsets[at][:, None] + np.arange(dim)]


def _fold(batches):
    """One summary of a task's rows for each length."""
    found: dict[int, Summary] = {}
    for batch in batches:
        for dim, _, x in matrices(batch["x"]):
            for at in range(0, len(x), CHUNK):
                own = Summary.of(x[at : at + CHUNK])
                found[dim] = found[dim].merged(own) if dim in found else own
    if found:
        yield _emit(found, TaskContext.get().partitionId())


def _merge(batches):
    """For summaries sorted by length and group: one of each group."""
    at, held = None, None
    for batch in batches:
        for row in batch.to_pylist():
            own = Summary.unpacked(row["n"], row["sums"], row["r"])
            if at == (row["dim"], row["node"]):
                held = held.merged(own)
            else:
                if at:
                    yield _emit({at[0]: held}, at[1])
                at, held = (row["dim"], row["node"]), own
    if at:
        yield _emit({at[0]: held}, at[1])


def summarised(vectors: DataFrame) -> DataFrame:
    """(dim, n, sums, r) of the distinct arrays x, one row for each length."""
    level = durable(vectors.select("x").mapInArrow(_fold, _SUMMARY))
    most = level.agg(F.max("node")).first()[0]
    while most:
        # Neighbouring groups of FAN meet; each level has a FANth of the rows of the last.
        level = level.withColumn("own", F.col("node")).withColumn("node", F.floor(F.col("node") / FAN))
        level = level.repartition("dim", "node").sortWithinPartitions("dim", "node", "own")
        level, most = durable(level.mapInArrow(_merge, _SUMMARY)), most // FAN
    return level


# -- the fit ----------------------------------------------------------------------------------------


@dataclass
class Space:
    """The fit of one length: axes are unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @staticmethod
    def of(summary: Summary, components: int) -> Space:
        _, s, v = np.linalg.svd(summary.r, full_matrices=True)
        values = np.zeros(len(summary.sums))
        values[: len(s)] = s**2 / summary.n
        # One sign for all: the entry of greatest size is positive.
        v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        return Space(summary.n, summary.sums, values[:components], v[:components].T, float(values.sum()))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - sums)^2, exact; null beyond 38 digits."""
        if self.n * int(np.abs(x).max()) + max(abs(int(s)) for s in self.sums) < 1 << 62:
            gap = x * np.int64(self.n) - self.sums.astype(np.int64)
            if int(np.abs(gap).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
                return (gap * gap).sum(axis=1).tolist()
        gap = x.astype(object) * self.n - self.sums
        return [int(d) if d < 10**38 else None for d in (gap * gap).sum(axis=1)]

    def varied(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > TINY * max(self.values.max(initial=0.0), TINY)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        near = np.array([int(s) // self.n for s in self.sums], np.int64)
        rest = np.array([int(s) % self.n for s in self.sums], float) / self.n
        varied = self.varied()
        scale = np.where(varied, 1 / np.sqrt(np.where(varied, self.values, 1.0)), 0.0)
        return ((x - near) - rest) @ self.axes * scale


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """The space of each length, of distinct arrays x; at most one matrix of length by length each."""
    rows = summarised(vectors).collect()
    return {r.dim: Space.of(Summary.unpacked(r.n, r.sums, r.r), components) for r in rows}


def identity_errors(vectors: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """For each length: the largest entry of the whitened vectors' covariance less the identity."""
    model = sent(vectors.sparkSession, spaces)

    def run(batches):
        own, sums = model(), {}
        for batch in batches:
            for dim, _, x in matrices(batch["x"]):
                z = own[dim].whitened(x)
                z = np.hstack([z, np.ones((len(z), 1))])
                sums[dim] = sums.get(dim, 0) + z.T @ z
        if sums:
            yield pa.RecordBatch.from_pylist([{"dim": d, "at": i, "v": float(v)} for d, m in sums.items() for i, v in enumerate(m.ravel())])

    # Products with a last entry of 1: second moments, means and the count in one matrix.
    cells = vectors.select("x").mapInArrow(run, "dim bigint, at bigint, v double").groupBy("dim", "at").agg(F.sum("v").alias("v"))
    errors = {}
    for row in cells.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("m")).collect():
        m = np.array([c.v for c in row.m])
        m = m.reshape(int(len(m) ** 0.5), -1)
        n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
        gap = m[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))
        varied = spaces[row.dim].varied()
        errors[row.dim] = float(np.abs(gap[varied][:, varied]).max(initial=0.0))
    return errors


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of
    embeddings(vec_id, embedding): a row for each usable vector and component."""
    usable = embeddings.select("vec_id", whole("embedding").alias("x")).where("size(x) > 0")
    distinct = written(usable.select("x").distinct())
    spaces = fit(distinct, components)
    errors = identity_errors(distinct, spaces)
    model = sent(embeddings.sparkSession, spaces)

    def run(batches):
        own = model()
        for batch in batches:
            for dim, at, x in matrices(batch["x"]):
                space = own[dim]
                z, k, rows = space.whitened(x), len(space.values), len(x)
                each = lambda values, kind: pa.array(np.repeat(values, k), kind)  # noqa: E731, B023
                explained = space.values / space.trace if space.trace else np.zeros(k)
                columns = [
                    batch["vec_id"].take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, space.n), pa.int64()),
                    pa.array([d for d in space.deviations(x) for _ in range(k)], pa.decimal128(38, 0)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, errors[dim])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return usable.mapInArrow(run, shape)
