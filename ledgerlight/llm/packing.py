"""Best-fit packing by a grouping genetic algorithm on distributed islands.

Documents are encoded, cut into pieces of at most ``size`` tokens only where they are longer, and dealt evenly into
cells of about ``per_cell`` pieces. Each cell is evolved by several islands; after each epoch the best packing of
an island moves to the next one (elite migration), and the best of all is taken in the end. A packing is a grouping:
crossover injects whole well-filled bins of one parent into the other, drops the bins that now hold a piece twice,
and best-fits the displaced pieces. Evolution starts from best fits in several orders and runs in every cell; in cells that
reach the lower bound it still gathers room in few bins, which the next level takes apart. The emptiest bins of each cell (filled below ``full``, at most ``tail``) are
taken apart and dealt into fewer cells, level by level until one is left, so that the cuts between cells cost
almost nothing. No task ever holds more than a cell.

Nulls: a null text is empty and takes one token, its end. Repeated rows and null ids are pieces of their own; an
empty table gives none. Other columns are ignored. Ties are broken by the order of pieces in a cell, which is
fixed by a hash, so results repeat.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import arrow_schema, map_batches, written
from ledgerlight.llm.pretokens import encoder

Bins = list[list[int]]
#: Bins, and how much each holds.
Packing = tuple[Bins, list[int]]


def placed(items: list[int], lengths: list[int], size: int, start: Packing = ((), ())) -> Packing:
    """Puts items, in the order given, where the least room is left; opens a bin where none has room. start stays as it is."""
    bins, fills = list(start[0]), list(start[1])
    room = sorted((size - f, k) for k, f in enumerate(fills))
    for i in items:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at == len(room):
            bins.append([i])
            fills.append(n)
            insort(room, (size - n, len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k] = [*bins[k], i]
            fills[k] += n
            insort(room, (left - n, k))
    return bins, fills


def longest_first(items: list[int], lengths: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-lengths[i], i))


def best_fit(items: list[int], lengths: list[int], size: int) -> Bins:
    """Best fit of the longest first: one of the packings that evolution starts from."""
    return placed(longest_first(items, lengths), lengths, size)[0]


def fitness(p: Packing, size: int) -> tuple[int, float]:
    """Fewer bins, then bins filled more unevenly: room gathered in one bin is room that can be used."""
    return len(p[0]), -sum((f / size) ** 2 for f in p[1])


def crossed(a: Packing, b: Packing, lengths: list[int], size: int, rng: random.Random, most: int) -> Packing:
    """Injects up to ``most`` of b's better-filled bins into a; bins of a that now hold an item twice go, and what they held besides is best-fitted."""
    full = sorted(range(len(b[0])), key=lambda k: -b[1][k])[: max(1, len(b[0]) // 2)]
    take = rng.sample(full, min(len(full), rng.randrange(1, most + 1)))
    inside = {i for k in take for i in b[0][k]}
    bins, fills, displaced = [b[0][k] for k in take], [b[1][k] for k in take], []
    for x, f in zip(*a, strict=True):
        if inside.isdisjoint(x):
            bins.append(x)
            fills.append(f)
        else:
            displaced += [i for i in x if i not in inside]
    return placed(longest_first(displaced, lengths), lengths, size, (bins, fills))


def mutated(a: Packing, lengths: list[int], size: int, rng: random.Random) -> Packing:
    """Takes some bins apart, the emptiest among them, and fits what they held in a random order, to leave the path of the longest first."""
    n = len(a[0])
    out = {min(range(n), key=a[1].__getitem__), *rng.sample(range(n), min(n, 3))}
    items = [i for k in out for i in a[0][k]]
    rng.shuffle(items)
    keep = [k for k in range(n) if k not in out]
    return placed(items, lengths, size, ([a[0][k] for k in keep], [a[1][k] for k in keep]))


def evolve(lengths: list[int], size: int, seed: int, elite: Bins | None, *, population: int = 6, generations: int = 10, most_generations: int = 60) -> Bins:
    """One epoch of one island: ``generations`` at least, then on until the lower bound is reached, ``most_generations`` at most."""
    rng = random.Random(seed)
    whole = [[i] for i, x in enumerate(lengths) if x >= size]
    items = [i for i, x in enumerate(lengths) if x < size]
    if not items:
        return whole
    least = -(-sum(lengths[i] for i in items) // size)
    rank = lambda p: fitness(p, size)
    if elite:
        kept = [b for b in elite if lengths[b[0]] < size]
        people = [(kept, [sum(lengths[i] for i in b) for b in kept])]
    else:
        people = [placed(longest_first(items, lengths), lengths, size)]
    # another order: nearly the longest first
    people.append(placed(sorted(items, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.2)), lengths, size))
    while len(people) < population:
        people.append(mutated(people[0], lengths, size, rng))
    people.sort(key=rank)
    for k in range(most_generations):
        if k >= generations and len(people[0][0]) <= least:
            break
        a, b = rng.sample(people[: max(2, population // 2 + 1)], 2)
        child = crossed(a, b, lengths, size, rng, max(1, min(4, len(a[0]) // 8)))
        if rng.random() < 0.5:
            child = mutated(child, lengths, size, rng)
        people = sorted([*people[: population - 1], child], key=rank)
    return whole + people[0][0]


def pieces(df: DataFrame, path: str, *, size: int = 4096, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, slot): documents cut to size. slot is even over all numbers and stable for a row."""
    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, slot bigint"
    tail = np.array([] if end is None else [end], "<u4")

    def make():
        from pyspark import TaskContext

        code, task, row = encoder(path), TaskContext.get().partitionId(), [0]

        def of(batch):
            out: list[tuple] = []
            for doc, found in zip(batch.column(0).to_pylist(), code.of_all(batch.column(1)), strict=True):
                ids = np.concatenate([found, tail])
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    row[0] += 1
                    out.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), hash((task, row[0])) >> 1))
            names = (id_col, "piece", "start", "length", "ids_crc32", "slot")
            return dict(zip(names, zip(*out, strict=True), strict=True)) if out else {n: [] for n in names}

        return of

    return map_batches(df.select(F.col(id_col), F.col(text_col)), make, ddl)


def pack(cut: DataFrame, *, size: int = 4096, per_cell: int = 2000, islands: int = 2, epochs: int = 2, full: float = 0.98, tail: int = 8, most_levels: int = 6, seed: int = 7) -> DataFrame:
    """Adds sequence_id and offset to rows with length and slot (as of ``pieces``). cut is read twice: give a written table."""
    names = [c for c in cut.columns if c != "slot"]
    ddl = "cell bigint, island int, elite array<array<int>>"
    schema = arrow_schema(ddl)

    def epoch(k: int):
        def run(batches):
            for batch in batches:
                got = []
                for j in range(batch.num_rows):
                    lengths = batch.column("lengths")[j].as_py()
                    elite = batch.column("elite")[j].as_py()
                    got.append(evolve(lengths, size, seed * 1_000_003 + batch.column("cell")[j].as_py() * 31 + batch.column("island")[j].as_py() * 7 + k, elite))
                yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("island"), pa.array(got, schema.field("elite").type)], schema=schema)

        return run

    done, level, rest = [], 0, cut
    while True:
        n = rest.count()
        cells = max(1, -(-n // per_cell))
        parts = max(1, min(cells, rest.sparkSession.sparkContext.defaultParallelism * 4))
        grouped = rest.withColumn("cell", F.pmod(F.xxhash64("slot", F.lit(level)), F.lit(cells))).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct(F.hash("slot").alias("h"), F.struct(*names, "slot").alias("i")))).alias("s")).select("cell", F.transform("s", lambda x: x["i"]).alias("items"))
        grouped = written(grouped)
        # the epochs are one plan with the bins: tables between them would only be more files
        sizes = grouped.select("cell", F.col("items.length").alias("lengths"))
        state = sizes.repartition(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.lit(None).cast("array<array<int>>").alias("elite")).mapInArrow(epoch(0), ddl)
        for k in range(1, epochs):
            moved = state.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "elite")
            state = sizes.join(moved, "cell").select("cell", "island", "lengths", "elite").repartition(parts, "cell", "island").mapInArrow(epoch(k), ddl)
        best = state.groupBy("cell").agg(F.min_by("elite", F.struct(F.size("elite"), "island")).alias("elite"))
        best = grouped.join(best, "cell").select("cell", "items", F.size("elite").alias("n_bins"), F.posexplode("elite").alias("bin", "at"))
        bins = best.select((F.lit(level * 2**56).cast("bigint") + F.col("cell") * 2**20 + F.col("bin")).alias("sequence_id"), F.transform("at", lambda i: F.get("items", i)).alias("b"), "cell", "bin", "n_bins").withColumn("fill", F.aggregate("b", F.lit(0).cast("bigint"), lambda s, x: s + x["length"]))
        last = cells == 1 or level == most_levels
        by_fill = Window.partitionBy("cell").orderBy("fill", "bin")  # no more bins than a cell has pieces
        poor = (F.col("fill") < full * size) & (F.row_number().over(by_fill) <= F.greatest(F.lit(1), F.least(F.lit(tail), (F.col("n_bins") / 4).cast("int")))) & F.lit(not last)
        bins = written(bins.withColumn("again", poor))
        keep = bins.where("not again")
        done.append(keep.select("sequence_id", F.posexplode("b").alias("p", "x"), F.col("b").alias("b")).select(*[F.col("x")[c].alias(c) for c in names], "sequence_id", F.aggregate(F.slice("b", F.lit(1), F.col("p")), F.lit(0).cast("bigint"), lambda s, x: s + x["length"]).alias("offset")))
        if last:
            break
        rest = written(bins.where("again").select(F.explode("b").alias("x")).select("x.*"))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def pieces_written(df: DataFrame, path: str, **options) -> DataFrame:
    """Pieces as a table of the shared folder: they are read more than once, and encoded only once."""
    return written(pieces(df, path, **options))
