"""Near-duplicate embeddings by random-hyperplane sign hashing.

Equal vectors of a label become one class first. Each class gets one signature of ``bits`` signs in each of several
tables; classes that share a signature in a table are compared by exact cosine in double precision. A pair that
meets in several tables counts in the first one only, so numbers of links are exact for the pairs found. bits follows
the largest label (buckets stay at about ``per_bucket``), and the number of tables follows bits, so that a pair at
the threshold is missed with a chance of ``miss`` at most, and closer pairs with less. Large buckets are compared in tiles
(see tiles.py); only spanning links and counts leave a tile. Components are found by distributed rounds.

Nulls: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with
nothing. Repeated rows are vectors of their own (they link with each other). A null id takes its component's id.
Vectors of different lengths never link. Ids may be of any type that has an order. Vectors are scaled by their largest component
first, so that no norm over- or underflows. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import arrow_schema, components, map_batches, written
from ledgerlight.llm.tiles import forest, tiled


def planes(n: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dim))


def plan(largest: int, threshold: float, per_bucket: int, miss: float) -> tuple[int, int]:
    """bits of a signature and number of tables."""
    bits = min(24, max(4, math.ceil(math.log2(max(1, largest) / per_bucket + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(miss) / math.log(1 - same)))


def near_vectors(df: DataFrame, *, threshold: float = 0.98, per_bucket: int = 32, miss: float = 0.0005, block: int = 512, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each row of df."""
    kind, id_kind = df.schema[label_col].dataType.simpleString(), df.schema[id_col].dataType.simpleString()

    def make():
        def of(batch):
            keys, vecs = [], []
            for y, v in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ok = y is not None and v and None not in v
                x = np.array(v, "<f8") if ok else None
                if ok and np.isfinite(x).all() and (most := np.abs(x).max()) > 0:
                    x = np.ldexp(x, -int(np.frexp(most)[1])) + 0.0  # by a power of two, which is exact; -0.0 is 0.0
                    keys.append(xxhash.xxh3_128_digest(repr(y).encode() + b"|" + x.tobytes()))
                    vecs.append(x.tobytes())
                else:
                    keys.append(None)
                    vecs.append(None)
            return {"id": batch.column("id"), "label": batch.column("label"), "node": pa.array(keys, pa.binary()), "vec": pa.array(vecs, pa.binary())}

        return of

    rows = written(map_batches(df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v")), make, f"id {id_kind}, label {kind}, node binary, vec binary"))
    classes = written(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("m"), F.min("id").alias("low"), F.first("vec").alias("vec")))
    largest = classes.groupBy("label", F.length("vec").alias("bytes")).count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold, per_bucket, miss)

    def sign():
        known: dict[int, np.ndarray] = {}

        def of(batch):
            sigs = []
            for v in batch.column("vec").to_pylist():
                x = np.frombuffer(v, "<f8")
                if len(x) not in known:
                    known[len(x)] = planes(bits * tables, len(x), seed)
                on = (known[len(x)] @ x > 0).reshape(tables, bits)
                sigs.append((on @ (1 << np.arange(bits))).tolist())
            return {"node": batch.column("node"), "label": batch.column("label"), "m": batch.column("m"), "vec": batch.column("vec"), "sigs": sigs}

        return of

    signed = map_batches(classes.select("node", "label", "m", "vec"), sign, f"node binary, label {kind}, m bigint, vec binary, sigs array<int>")
    # buckets without vectors first, to size them; a bucket is one of a label, a length and a table
    bucket = F.xxhash64("label", F.length("vec"), "t", "sig")
    signed = written(signed.select("*", F.posexplode("sigs").alias("t", "sig")).withColumn("bucket", bucket).drop("sig"))
    sizes = written(signed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = tiled(signed.join(sizes, "bucket"), F.ceil(F.col("size") / block), F.xxhash64("node"))
    schema = arrow_schema("a binary, b binary, n bigint")

    def compare(tile: pa.Table) -> pa.Table:
        """Links of one tile: (node, null, number of vectors linked) and, for components, (node, node, 0)."""
        node, t = tile.column("node").to_pylist(), tile.column("t")[0].as_py()
        m, block_of = np.array(tile.column("m")), np.array(tile.column("block"))
        x = np.stack([np.frombuffer(v, "<f8") for v in tile.column("vec").to_pylist()]) if len({len(v) for v in tile.column("vec").to_pylist()}) == 1 else None
        out: list[tuple] = []
        if x is not None:
            norm = np.sqrt((x * x).sum(1))
            sigs, label = np.array(tile.column("sigs").to_pylist()), np.unique([repr(y) for y in tile.column("label").to_pylist()], return_inverse=True)[1]
            alike = (x / norm[:, None]) @ (x / norm[:, None]).T >= threshold - 1e-9
            i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
            alike &= np.triu(np.ones(alike.shape, bool), 1) if i == j else (block_of[:, None] == i) & (block_of[None, :] == j)
            pairs = np.argwhere(alike)
            kept = [pairs[:0]]
            for some in np.array_split(pairs, -(-len(pairs) // 4096) or 1):
                a, b = some.T
                cosine = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b])
                # a pair that meets in several tables counts in the first
                kept.append(some[((sigs[a] == sigs[b]).argmax(1) == t) & (label[a] == label[b]) & (cosine >= threshold)])
            ab = np.concatenate(kept)
            if len(ab):
                n = np.zeros(len(node), np.int64)
                np.add.at(n, ab[:, 0], m[ab[:, 1]])
                np.add.at(n, ab[:, 1], m[ab[:, 0]])
                out += [(node[k], None, int(n[k])) for k in np.flatnonzero(n)]
                out += [(node[a], node[b], 0) for a, b in forest(map(tuple, ab.tolist()))]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    found = written(members.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary, n bigint"))
    linked = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of_node = components(found.where("b is not null").select("a", "b"))
    low = classes.select("node", "m", "low").join(linked, "node", "left").join(of_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = written(low.groupBy("component").agg(F.min("low").alias("component_id")))
    answer = written(low.join(ids, "component").select("node", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.select("id", "node").join(answer, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


__all__ = ["near_vectors", "plan", "planes"]
