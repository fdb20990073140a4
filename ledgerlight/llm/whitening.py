"""Whitening of embeddings by the Gramian of exactly centred rows.

Entries become integers, so sums are exact, and n * x - S is the exact distance from the mean, n times. Rows centred by it
go to MLlib's RowMatrix; its Gramian divided by n is the covariance, whose eigenvectors are found on the driver (a matrix of
dim x dim, whatever the number of rows) and broadcast; rows are projected and scaled in mapInPandas. The covariance of what
comes out is measured by a second Gramian.

Sums leave a task as one row for each batch, so the first shuffle moves dim numbers a batch. Nothing else is shuffled.

Nulls: vectors that are null or hold null or non-finite entries are dropped, and so are vectors without entries and those
whose integers leave 53 bits. Vectors of different lengths are fitted each on their own. Repeated rows are rows of their own,
ids (null ones too) are passed on and needn't be unique, other columns are ignored, and an empty table gives an empty one. A
direction in which rows don't differ (beyond rounding) can't be scaled: whitened is null there and it has no part in
identity_error, which is 0 where no direction is left. A deviation beyond a long is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import arrow_schema, drop, written

#: What entries are multiplied by and moved by.
SCALE, SHIFT = 64, 1_000_000
LONG = 2**63 - 1


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): the vectors that can be fitted, as integers."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fit = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**52 / SCALE))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fit, F.lit(False))).select("id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def matrix(column: pd.Series | pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy())


def sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length of vectors: their number and the exact sum of each dimension."""
    ddl = "dim int, n bigint, s array<bigint>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            x = batch.column(0)
            lengths = np.asarray(x.value_lengths())
            for dim in np.unique(lengths).tolist():
                own = matrix(x.filter(pa.array(lengths == dim)))
                # 2^53 times a batch may leave 64 bits: high and low parts are summed apart
                high, low = np.divmod(own, 1 << 32)
                yield pa.RecordBatch.from_arrays([pa.array([dim, dim], pa.int32()), pa.array([len(own), -1], pa.int64()), pa.array([low.sum(0), high.sum(0)], pa.list_(pa.int64()))], names=schema.names)

    parts = rows.select("x").mapInArrow(run, ddl)
    numbers = parts.where("n >= 0").groupBy("dim").agg(F.sum("n").alias("n"))
    total = parts.select("dim", (F.col("n") < 0).alias("high"), F.posexplode("s").alias("k", "v")).groupBy("dim", "high", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    count = {r.dim: r.n for r in numbers.collect()}
    found: dict[int, list[int]] = {d: [0] * d for d in count}
    for r in total.collect():  # two numbers for each dimension
        found[r.dim][r.k] += int(r.v) << (32 if r.high else 0)
    return {d: (count[d], found[d]) for d in sorted(count)}


class Centre:
    """n * x - S, exactly: rows are moved by the whole part of the mean first, so that products stay small."""

    def __init__(self, n: int, s: list[int]) -> None:
        self.n, self.dim = n, len(s)
        self.whole = np.array([t // n for t in s], np.int64)
        self.rest = np.array([t % n for t in s], np.int64)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """In 64 bits where they hold it, else as Python's integers."""
        moved = x - self.whole
        if len(x) and int(np.abs(moved).max()) + 1 > LONG // self.n:
            moved = moved.astype(object)
        return moved * self.n - self.rest

    def squares(self, d: np.ndarray) -> list[int | None]:
        """Exact sums of squares of each row."""
        most = max((abs(int(v)) for v in (d.max(initial=0), d.min(initial=0))), default=0)
        exact = d if most * most * self.dim <= LONG else d.astype(object)
        return [int(v) if v <= LONG else None for v in (exact * exact).sum(1).tolist()]

    def centred(self, d: np.ndarray) -> np.ndarray:
        return (d / self.n).astype(np.float64)


def gramian(vectors: DataFrame, n: int, dim: int) -> np.ndarray:
    """Sum of the outer products of column v."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(rows, n, dim).computeGramianMatrix().toArray()


def directions(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, unit eigenvectors as columns and shares of the trace, by falling eigenvalue; eigenvalues within rounding of 0 are 0."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    trace = float(np.trace(covariance))
    noise = max(float(np.abs(values).max(initial=0)), 0.0) * len(covariance) * np.finfo(float).eps * 4
    values = np.where(values > noise, values, 0.0)
    return values, vectors, values / trace if trace > 0 else np.zeros_like(values)


def whiten(df: DataFrame, *, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n, deviation, whitened, explained, identity_error), one row for each vector that can be fitted; whitened and
    explained are arrays by component, by falling variance, of at most ``components``."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = written(integers(df, id_col, vec_col))
    ddl = f"`{id_col}` {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    out = None
    for dim, (n, s) in sums(rows).items():
        own, centre = rows.where(F.size("x") == dim), Centre(n, s)

        def with_x(batches, of, name="x"):
            for batch in batches:
                if len(batch):
                    yield of(batch, matrix(batch[name]))

        def centred(batches, centre=centre):
            return with_x(batches, lambda _, x: pd.DataFrame({"v": list(centre.centred(centre.deviations(x)))}))

        values, vectors, explained = directions(gramian(own.select("x").mapInPandas(centred, "v array<double>"), n, dim) / n, components)
        usable = values > 0
        shared = spark.sparkContext.broadcast(vectors / np.sqrt(np.where(usable, values, 1.0)))

        def projected(batches, centre=centre, shared=shared, usable=usable):
            return with_x(batches, lambda _, x: pd.DataFrame({"v": list((centre.centred(centre.deviations(x)) @ shared.value)[:, usable])}))

        error = 0.0
        if usable.any():
            # of the numbers that go out: their means first, then the Gramian of what they differ from them
            flat = own.select("x").mapInPandas(projected, "v array<double>")

            def means(batches):
                yield from with_x(batches, lambda _, v: pd.DataFrame({"v": [v.sum(0)]}), "v")

            mean = [0.0] * int(usable.sum())
            for k, total in flat.mapInPandas(means, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v")).collect():
                mean[k] = total / n

            def moved(batches, mean=tuple(mean)):
                return with_x(batches, lambda _, v: pd.DataFrame({"v": list(v - np.array(mean))}), "v")

            error = float(np.abs(gramian(flat.mapInPandas(moved, "v array<double>"), n, len(mean)) / n - np.eye(len(mean))).max())

        def answers(batches, centre=centre, shared=shared, usable=usable, error=error, explained=explained):
            def of(batch, x):
                d = centre.deviations(x)
                w = centre.centred(d) @ shared.value
                made = list(w) if usable.all() else [[float(v) if ok else None for v, ok in zip(row, usable)] for row in w]
                return pd.DataFrame({id_col: batch["id"], "n": centre.n, "deviation": pd.array(centre.squares(d), "Int64"), "whitened": made, "explained": [explained] * len(x), "identity_error": error})

            return with_x(batches, of)

        found = own.select("id", "x").mapInPandas(answers, ddl)
        out = found if out is None else out.unionByName(found)
    if out is None:
        drop(rows)
        return spark.createDataFrame([], ddl)
    return out


def by_component(found: DataFrame) -> DataFrame:
    """A row for each component of a vector."""
    both = found.withColumn("both", F.explode(F.arrays_zip(F.transform("whitened", lambda _, k: k.cast("int") + 1).alias("component"), F.col("whitened"), F.col("explained"))))
    return both.select(*(c for c in found.columns if c not in ("whitened", "explained", "both")), "both.component", "both.whitened", "both.explained")
