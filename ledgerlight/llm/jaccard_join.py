"""Near-copies by Jaccard similarity of word shingles: a size-aware heavy-light join.

Documents with equal shingle sets are one class. Two classes link when ``num`` percent of their union is shared.

* Light sets (few shingles): every subset of the size that a link needs is enumerated; linked light sets share one.
* Heavy sets: a global order puts rare shingles first, and linked sets share a shingle among the first
  n - ceil(n * num / 100) + 1 of each. These go into inverted lists, which are scanned.

The boundary between them has the least estimated cost. The order follows counts of hashed shingles over all
documents in a table of fixed size, so the prefix of a document avoids lines and passages that many share.

Lists are scanned without writing out their pairs: first each member is compared with the list's hub (the member
found in most lists), which joins nearly all of a group of near-copies; then only lists that still hold several components
are compared in full, in tiles of bounded size (tiles.py), from which only links that join components come out.

Each class has a parity sketch: one bit for each of 512 buckets or more (half as many as shingles, at least), whether it holds
an odd number of its shingles. Two sketches differ in no more bits than the sets differ in shingles, also when the
longer is folded to the shorter, so pairs that differ too much are left out without their texts, and none that links is. What remains is compared exactly, on whole sets (64-bit hashes of shingles).

Nulls: documents without words or text have an empty set and link with nothing. Rows with a null id take part but
give their component no id. Repeated rows are copies of each other. Ids may be of any type that has an order. Empty tables give
empty results; columns other than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import Recent, arrow_schema, components, drop, mixed, shingle_hashes, trim, word_hashes, written
from ledgerlight.llm.tiles import forest, tiled

#: Bits of the table of shingle counts: it grows with the corpus between these, 64 MB at most. And entries of a slice of it.
LEAST_BITS, MOST_BITS, SLICE = 20, 24, 1 << 16
#: Least bits of a parity sketch.
SKETCH = 512
#: Classes up to which their keys are broadcast (24 MB); beyond, texts are shuffled to them.
BROADCAST = 1_000_000


def required(a: int, b: int, num: int) -> int:
    """Shared shingles that sets of sizes a and b need at least."""
    return -(-num * (a + b) // (100 + num))


def least_partner(n: int, num: int) -> int:
    return -(-n * num // 100)


def most_partner(n: int, num: int) -> int:
    return n * 100 // num


def prefix_length(n: int, num: int) -> int:
    return n - least_partner(n, num) + 1


def subset_sizes(n: int, boundary: int, num: int) -> set[int]:
    return {required(n, b, num) for b in range(least_partner(n, num), min(boundary, most_partner(n, num)) + 1)}


def boundary_of(sizes: dict[int, int], num: int, scan_cost: float, most: int = 40) -> int:
    """The largest size of a light set, by least cost: subsets enumerated against postings whose lists are scanned."""

    def cost(x: int) -> float:
        light = sum(k * sum(comb(n, o) for o in subset_sizes(n, x, num) if o <= n) for n, k in sizes.items() if n <= x)
        return light + sum(k * prefix_length(n, num) * scan_cost for n, k in sizes.items() if n > x or most_partner(n, num) > x)

    return min(range(most + 1), key=cost)


def set_of(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; A-Z count as a-z."""
    x = shingle_hashes(word_hashes(text), k)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def key_of(x: np.ndarray) -> bytes | None:
    """Names a set; None for the empty one."""
    return xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None


def sketch_of(x: np.ndarray) -> bytes:
    width = SKETCH << max(0, (len(x) - 1) // (2 * SKETCH)).bit_length()
    return np.packbits((np.bincount((x >> np.uint64(30)) & np.uint64(width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bytes: what falls into one bucket is added up. Works on rows too."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def allowed(a, b, num: int):
    """Shingles in which linked sets of sizes a and b may differ."""
    return a + b - 2 * -(-num * (a + b) // (100 + num))


def some_at_a_time(batches, rows: int = 256):
    """Batches in slices, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def buckets_for(n: int) -> int:
    """Entries of the table of counts for so many documents."""
    return 1 << min(MOST_BITS, max(LEAST_BITS, (n // 4).bit_length()))


def keys_and_counts(docs: DataFrame, k: int, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """kind 0: (id, th, key, n, sketch) of each row, th a hash of its text; kind 1: a slice (n) of this task's shingle counts."""
    ddl = f"kind int, id {docs.schema[id_col].dataType.simpleString()}, th bigint, key binary, n bigint, sketch binary, counts binary"
    schema = arrow_schema(ddl)

    def run(batches):
        counts = np.zeros(buckets, np.int32)
        for batch in some_at_a_time(batches):
            sets = [set_of(t, k) for t in batch.column(2).to_pylist()]
            own, n = np.unique(np.concatenate([np.array([], np.uint64), *sets]) & np.uint64(buckets - 1), return_counts=True)
            counts[own.astype(np.int64)] += n.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), batch.column(0), batch.column(1), pa.array(map(key_of, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([sketch_of(x) if len(x) else None for x in sets], pa.binary()), pa.nulls(len(sets), pa.binary())], schema=schema)
        if counts.any():
            n = buckets // SLICE
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.nulls(n, schema.field("id").type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int64()), pa.nulls(n, pa.binary()), pa.array([np.minimum(counts[i * SLICE : (i + 1) * SLICE], 65_535).astype(np.uint16).tobytes() for i in range(n)], pa.binary())], schema=schema)
        del counts
        trim()

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def bucket_counts(slices: DataFrame, buckets: int) -> np.ndarray:
    """The counts of all tasks summed, in two steps; ``buckets`` numbers in all. They only order shingles, so a task's may be cut off at 65535."""
    schema = arrow_schema("id bigint, part int, counts binary")

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64 if len(x) == SLICE * 8 else np.uint16).astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table([pa.array([table.column("id")[0].as_py()]), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    once = slices.select("id", (F.rand(1) * 16).cast("int").alias("part"), "counts").groupBy("id", "part").applyInArrow(summed, "id bigint, part int, counts binary")
    out = np.zeros(buckets, np.int32)
    for r in once.groupBy("id").applyInArrow(summed, "id bigint, part int, counts binary").collect():
        out[r.id * SLICE : (r.id + 1) * SLICE] = np.minimum(np.frombuffer(bytes(r.counts), np.int64), 2**31 - 1)
    return out


def postings(docs: DataFrame, counts: np.ndarray, boundary: int, num: int, k: int, text_col: str) -> DataFrame:
    """(token, key, n): subsets of light sets, and the prefixes of sets that may have a heavy partner.

    Copies within a task post once, so even a group of copies that holds most rows is small."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = arrow_schema("token bigint, key binary, n bigint")

    def run(batches):
        count, seen = shared.value, Recent(lambda key: True, 100_000)
        for batch in some_at_a_time(batches):
            tokens, keys, sizes = [np.array([], np.uint64)], [], []
            for text in batch.column(0).to_pylist():
                x = set_of(text, k)
                key, n = key_of(x), len(x)
                if not n or key in seen or key in seen.old:
                    continue
                seen[key]
                out = []
                if n <= boundary:
                    for o in subset_sizes(n, boundary, num):
                        out += [xxhash.xxh3_64_intdigest(x[list(c)].tobytes(), o) for c in combinations(range(n), o)]
                if n > boundary or most_partner(n, num) > boundary:
                    c = count[x & np.uint64(len(count) - 1)]
                    p = prefix_length(n, num)
                    near = np.flatnonzero(c <= np.partition(c, p - 1)[p - 1])  # those that may be among the first p
                    first = x[near[np.lexsort((x[near], c[near]))[:p]]]
                    out += mixed(first).tolist()
                tokens.append(np.array(out, np.uint64))
                keys += [key] * len(out)
                sizes += [n] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], schema=schema)
        del seen
        trim()

    return docs.select(F.col(text_col)).mapInArrow(run, "token bigint, key binary, n bigint")


def shared_lists(listed: DataFrame) -> DataFrame:
    """Rows of tokens with two keys or more, once each; one shuffle, then one pass over sorted rows that keeps a row at a time."""
    schema = arrow_schema("token bigint, key binary, n bigint")

    def run(batches):
        held, out_already = None, False  # the last row, and whether it has gone out
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            token, key = t.column(0).to_numpy(), t.column(1).to_pylist()
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | np.fromiter((a != b for a, b in zip(key[1:], key[:-1], strict=True)), bool, len(key) - 1)
            keep = np.flatnonzero(new)
            joined = token[keep][1:] == token[keep][:-1]
            send = np.concatenate([[False], joined]) | np.concatenate([joined, [False]])
            gone = out_already if len(keep) == 1 else bool(send[-1])
            if out_already:
                send[0] = False
            t = t.take(pa.array(keep))
            held, out_already = t.slice(len(keep) - 1).combine_chunks().to_batches()[0], gone
            yield from t.filter(pa.array(send)).cast(schema).to_batches()
        trim()

    return listed.repartition("token").sortWithinPartitions("token", "key").mapInArrow(run, "token bigint, key binary, n bigint")


@dataclass
class Source:
    """The documents, and whether some rows of theirs repeat both id and text."""

    docs: DataFrame
    id_col: str
    text_col: str
    repeated: bool

    def texts(self, wanted: DataFrame) -> DataFrame:
        """Rows of wanted (with rep_id and rep_th, a document) and the text of that document. Few are broadcast to the scan; else texts are shuffled."""
        few = wanted.limit(BROADCAST + 1).count() <= BROADCAST
        rows = self.docs.select(F.col(self.id_col).alias("id"), F.xxhash64(self.text_col).alias("th"), F.col(self.text_col).alias("text"))
        found = rows.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))).drop("id", "th", "rep_id", "rep_th")
        keys = [c for c in found.columns if c != "text"]
        return found.groupBy(*keys).agg(F.first("text").alias("text")) if self.repeated else found


def verified(pairs: DataFrame, reps: DataFrame, source: Source, num: int, k: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by their whole sets. The text of a goes to b, once; b may be in many pairs."""
    left = written(pairs.join(reps.withColumnRenamed("key", "a"), "a"))
    right = written(pairs.select("b").distinct().join(reps.withColumnRenamed("key", "b"), "b"))
    both = source.texts(left).withColumnRenamed("text", "x").join(source.texts(right).withColumnRenamed("text", "y"), "b")
    schema = arrow_schema("a binary, b binary")

    def run(batches):
        def named(text):
            x = set_of(text, k)
            return key_of(x), x

        sets = Recent(named, 64)
        for batch in some_at_a_time(batches):
            ok = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                (p, x), (q, y) = sets[x], sets[y]
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum()) if p == a and q == b else -1  # texts of one hash may differ
                ok.append(both >= 0 and 100 * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(ok))
        del sets
        trim()

    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def likely(pairs: DataFrame, listed: DataFrame, num: int) -> DataFrame:
    """Pairs (a, b, hub_degree) that may link by sizes and sketches."""
    named = lambda side: listed.select(F.col("key").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"))
    near = 100 * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n")
    rows = pairs.join(named("a"), "a").join(named("b"), "b").where(near)
    schema = arrow_schema("a binary, b binary, hub_degree bigint")

    def run(batches):
        for batch in batches:
            most = allowed(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy(), num).tolist()
            ok = []
            for x, y, m in zip(batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist(), most, strict=True):
                size = min(len(x), len(y))
                ok.append(int(np.bitwise_count(folded(np.frombuffer(x, np.uint8), size) ^ folded(np.frombuffer(y, np.uint8), size)).sum()) <= m)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in schema], schema=schema).filter(pa.array(ok))
        trim()

    return rows.mapInArrow(run, "a binary, b binary, hub_degree bigint")


def candidates_in_tile(tile: pa.Table, num: int) -> np.ndarray:
    """Members of a tile that may link with one of another component, by their sketches; widths a step apart at most can meet."""
    raw, n = tile.column("sketch").to_pylist(), np.array(tile.column("n"), np.int64)
    comp = np.unique([c.hex() for c in tile.column("comp").to_pylist()], return_inverse=True)[1]
    sizes, hit = np.array([len(x) for x in raw]), np.zeros(len(raw), bool)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        others = np.flatnonzero((sizes == size) | (sizes == 2 * size))
        bits = {int(i): folded(np.frombuffer(raw[i], np.uint8), size) for i in others}
        x = np.unpackbits(np.stack([bits[int(i)] for i in own]), axis=1).astype(np.float32)
        y = np.unpackbits(np.stack([bits[int(i)] for i in others]), axis=1).astype(np.float32)
        differ = x.sum(1)[:, None] + y.sum(1)[None, :] - 2 * (x @ y.T)
        a, b = n[own][:, None], n[others][None, :]
        ok = (differ <= allowed(a, b, num)) & (100 * np.minimum(a, b) >= num * np.maximum(a, b)) & (comp[own][:, None] != comp[others][None, :])
        hit[own] |= ok.any(1)
        hit[others] |= ok.any(0)
    return np.flatnonzero(hit)


def linked_in_tile(tile: pa.Table, num: int, k: int) -> list[tuple[int, int]]:
    """Rows of a tile that link across components, as a spanning forest."""
    sets = [set_of(t, k) for t in tile.column("text").to_pylist()]
    sets = [x if key_of(x) == key else x[:0] for x, key in zip(sets, tile.column("key").to_pylist(), strict=True)]  # an id may stand on rows with other texts
    n = np.array([len(x) for x in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at, row = at.ravel(), np.repeat(np.arange(len(sets)), n)
    # shingles of a single set share nothing
    keep = counts[at] > 1
    place = np.cumsum(counts > 1) - 1
    at, row = place[at[keep]], row[keep]
    shared, width = np.zeros((len(sets), len(sets)), np.float32), 1 << 14
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        here = (at >= start) & (at < start + width)
        m = np.zeros((len(sets), width), np.float32)
        m[row[here], at[here] - start] = 1
        shared += m @ m.T
    _, comp = np.unique([c.hex() for c in tile.column("comp").to_pylist()], return_inverse=True)
    hit = (shared > 0) & (100 * shared.astype(np.int64) >= num * (n[:, None] + n[None, :] - shared.astype(np.int64)))
    hit &= np.triu(comp[:, None] != comp[None, :], 1)
    parts = [(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)]
    # members of one component are joined already
    return [parts[k] for k in _spanning([(int(comp[a]), int(comp[b])) for a, b in parts])]


def _spanning(pairs: list[tuple[int, int]]) -> list[int]:
    kept = forest(pairs)
    first = {}
    for k, p in enumerate(pairs):
        first.setdefault(p, k)
    return [first[p] for p in kept]


def near_copies(docs: DataFrame, *, num: int = 90, k: int = 3, scan_cost: float = 4.0, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id), one row for each row: component_id is the smallest id reachable by links."""
    buckets = buckets_for(docs.count())
    found = written(keys_and_counts(docs, k, id_col, text_col, buckets))
    rows = found.where("kind = 0").select("id", "key", "n")
    full = found.where("kind = 0 and key is not null")
    sizes = {r.n: r["count"] for r in full.where(F.col("n") <= 40).groupBy("n").count().collect()}
    boundary = boundary_of(sizes, num, scan_cost)
    members = written(shared_lists(postings(docs, bucket_counts(found.where("kind = 1").select(F.col("n").alias("id"), "counts"), buckets), boundary, num, k, text_col)))
    source = Source(docs, id_col, text_col, not full.groupBy("id", "th").count().where("count > 1").isEmpty())
    classes = full.groupBy("key").agg(F.min("id").alias("low"), F.min(F.struct("id", "th")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.select("key", "low", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th"), "n", "sketch"))
    listed = written(classes.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("degree")), "key"))

    hubs = written(members.join(listed.select("key", "degree"), "key").groupBy("token").agg(F.max(F.struct("degree", "key")).alias("hub"), F.count(F.lit(1)).alias("m")).select("token", F.col("hub.key").alias("hub"), F.col("hub.degree").alias("hub_degree"), "m"))
    reps = listed.select("key", "rep_id", "rep_th")
    pairs = written(members.join(hubs, "token").where(F.col("key") != F.col("hub")).select(F.col("key").alias("a"), F.col("hub").alias("b"), "hub_degree").distinct())
    pairs = written(likely(pairs, listed, num))
    # each member with its best hub, then with its other hubs where those are in other components still
    best = written(pairs.groupBy("a").agg(F.max(F.struct("hub_degree", "b")).alias("h")).select("a", F.col("h.b").alias("b")))
    links = written(verified(best, reps, source, num, k))
    comps = components(links)
    of = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"{side}_comp"))
    left = written(pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce("a_comp", "a").eqNullSafe(F.coalesce("b_comp", "b"))).select("a", "b"))
    others = written(verified(left, reps, source, num, k))
    if not others.isEmpty():
        links = written(links.union(others))
        drop(comps)
        comps = components(links)
    drop(pairs, best, left)

    # lists in which pairs other than those with the hub are left, each set of members once
    open_lists = members.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    open_lists = written(open_lists.join(hubs.where("m > 2").select("token"), "token"))
    kept_lists = open_lists.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64("key", F.lit(7)).cast("decimal(38,0)")).alias("h2")).where("lo <> hi")
    kept_lists = written(kept_lists.groupBy("m", "h1", "h2").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("m") / block).alias("blocks")))
    open_lists = open_lists.select("token", "key", "comp").join(kept_lists, "token").join(listed.select("key", "n", "sketch"), "key")
    schema, row = arrow_schema("a binary, b binary"), "token bigint, i int, j int, key binary, comp binary"
    row_schema = arrow_schema(row)

    def candidates(tile: pa.Table) -> pa.Table:
        return tile.select(row_schema.names).take(pa.array(candidates_in_tile(tile, num))).cast(row_schema)

    tiles = written(tiled(open_lists, F.col("blocks"), F.xxhash64("key")).select("token", "i", "j", "key", "comp", "n", "sketch").groupBy("token", "i", "j").applyInArrow(candidates, row))

    def compare(tile: pa.Table) -> pa.Table:
        key = tile.column("key").to_pylist()
        got = linked_in_tile(tile, num, k) if len(key) > 1 else []
        return pa.table([pa.array([key[a] for a, _ in got], pa.binary()), pa.array([key[b] for _, b in got], pa.binary())], schema=schema)

    texts = source.texts(written(reps.join(tiles.select("key").distinct(), "key", "left_semi")))
    more = written(tiles.join(texts, "key").groupBy("token", "i", "j").applyInArrow(compare, "a binary, b binary"))
    if not more.isEmpty():
        comps = components(links.union(more))
    return labelled(rows, classes, comps, id_col)


def labelled(rows: DataFrame, classes: DataFrame, comps: DataFrame, id_col: str) -> DataFrame:
    of_class = written(classes.join(comps.withColumnRenamed("node", "key"), "key", "left").select("key", "low", F.coalesce("component", "key").alias("comp")))
    ids = written(of_class.groupBy("comp").agg(F.min("low").alias("component_id")))
    answer = written(of_class.join(ids, "comp").select("key", "component_id"))
    return rows.select("id", "n", "key").join(answer, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
