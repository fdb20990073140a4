"""Fuzzy passages that repeat across documents, by collinear chaining of shared k-mer seeds.

1. Words are hashed (A-Z as a-z), runs of ``k`` words are k-mers, and winnowing keeps the least k-mer of every
   ``window``, so that equal stretches of window + k - 1 words share a seed wherever they stand.
2. Each seed that two documents hold links its occurrences to the first document that has it (smallest id), never
   all to each other: as many matches as occurrences. The n-th occurrence within a text goes with the n-th there; one beyond those
   that the first document has goes with its first occurrence too, so at most two matches each. The first document comes from an aggregation with partial
   minima, and the join back to it is one that Spark can split where a seed is hot.
3. The matches of a pair of documents are chained: ordered in both, with gap costs, by a Fenwick tree over the places
   in the first document that holds the best chain so far.
4. Chains are aligned on the words themselves, between seeds and beyond the ends, and kept where they cover
   ``least`` words or more of the later document with an identity of ``identity`` or more. A chain below that identity
   is split at the stretches that take it there, and each part is judged on its own.

The first document keeps its passage; later ones have theirs as spans. A document is (id, text): rows that repeat both are
one document and get the same spans, and rows that share an id, or have none, are compared like any others. Ids are whole numbers, or else
anything that is ordered as text. A null text has no words; rows with a null id come first in the order. Empty
tables give empty results; other columns are ignored. Texts are whole, of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.common import WORD, Recent, arrow_schema, drop, fresh, map_batches, mixed, shingle_hashes, word_hashes, written

#: Documents up to which their keys are broadcast (32 MB); beyond, texts are shuffled to them.
BROADCAST = 1_000_000
NO_ID = -(2**63)
#: Score of a seed, and the cost of a word passed over in either document between seeds.
SEED, GAP = 10.0, 0.1


def key_of(df: DataFrame, id_col: str) -> tuple[Column, str]:
    """An id in its order, null first, without nulls; and its type."""
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        return F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)), "bigint"
    return F.when(F.col(id_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(id_col).cast("string"))), "string"


def shown(key: Column, kind: str) -> Column:
    if kind == "bigint":
        return F.when(key != NO_ID, key.cast("string")).otherwise("null")
    return F.when(key != "", F.substring(key, 2, 2**31 - 1)).otherwise("null")


def winnowed(kmers: np.ndarray, window: int) -> np.ndarray:
    """Places of the seeds: of each window's least k-mer, the first where equal."""
    n = len(kmers)
    if n <= window:
        return np.array([int(kmers.argmin())] if n else [], np.int64)
    least = np.lib.stride_tricks.sliding_window_view(kmers, window).argmin(1)
    at = least + np.arange(len(least))
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def numbered(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds that a text holds more than once, told apart by their number: the second occurrence here goes with the second there.
    And whether each is such a later occurrence.

    So a text that repeats itself matches another one along its whole length, with no more matches than seeds."""
    order = np.argsort(seeds, kind="stable")
    x = seeds[order]
    new = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.array([], bool)
    if new.all():
        return seeds, np.zeros(len(seeds), bool)
    at = np.arange(len(x))
    number = np.empty(len(x), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(number > 0, mixed(seeds + number * np.uint64(0x9E3779B97F4A7C15)), seeds), number > 0


def chains(places: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint local chains of matches (place here, place there), best first, of two matches or more."""
    places = sorted(set(places))
    rank = {h: r + 1 for r, h in enumerate(sorted({h for _, h in places}))}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(rank) + 1)
    score, back = [0.0] * len(places), [-1] * len(places)
    i = 0
    while i < len(places):
        j = i
        while j < len(places) and places[j][0] == places[i][0]:  # those at one place don't follow each other
            p, h = places[j]
            best, r = (-1e18, -1), rank[h] - 1
            while r:
                if tree[r] > best:
                    best = tree[r]
                r &= r - 1
            gain = best[0] - GAP * (p + h)
            score[j], back[j] = (SEED + gain, best[1]) if gain > 0 else (SEED, -1)
            j += 1
        for x in range(i, j):
            p, h = places[x]
            value, r = (score[x] + GAP * (p + h), x), rank[h]
            while r < len(tree):
                if tree[r] < value:
                    tree[r] = value
                r += r & -r
        i = j
    used, out = [False] * len(places), []
    for end in sorted(range(len(places)), key=lambda x: -score[x]):
        chain, x = [], end
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(places[x])
            x = back[x]
        if len(chain) > 1:
            out.append(chain[::-1])
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short stretches."""
    if len(a) == len(b) and (same := int((a == b).sum())) >= len(a) - 1:
        return same
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        new = row.copy()
        hit = np.flatnonzero(b == x)
        new[hit + 1] = row[hit] + 1
        row = np.maximum.accumulate(np.maximum(new, row))
    return int(row[-1])


def reach(a: np.ndarray, b: np.ndarray, drop: int = 6, price: int = 2) -> tuple[int, int, int]:
    """How far two sequences go on alike from their starts: words of each, and matches. A word that differs costs
    ``price``, and the walk ends where it has lost ``drop`` since its best; it may step over a word in either."""
    i = j = matches = 0
    score, best = 0, (0, 0, 0, 0)
    while i < len(a) and j < len(b) and score > best[0] - drop:
        if a[i] == b[j]:
            n = min(len(a) - i, len(b) - j)
            differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
            run = int(differ[0]) if len(differ) else n
            i, j, matches, score = i + run, j + run, matches + run, score + run
            best = max(best, (score, i, j, matches))
            continue
        score -= price
        for x, y in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2)):  # the least step after which two words agree
            if np.array_equal(a[i + x : i + x + 2], b[j + y : j + y + 2]) and len(a[i + x : i + x + 2]) == 2:
                i, j = i + x, j + y
                break
        else:
            i, j = i + 1, j + 1
    return best[1], best[2], best[3]


def links(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Seeds of a chain that agree with each other, and the words in common that each adds to the one before."""
    # seeds may overlap: those off the diagonal of the last one that they overlap are left out
    kept, matches = [chain[0]], []
    for p, h in chain[1:]:
        q, g = kept[-1]
        if p - q == h - g:
            matches.append(min(p - q, k) + (int((a[q + k : p] == b[g + k : h]).sum()) if p > q + k else 0))
        elif p >= q + k and h >= g + k:
            matches.append(k + common_words(a[q + k : p], b[g + k : h]))
        else:
            continue
        kept.append((p, h))
    return kept, matches


def grown(a: np.ndarray, b: np.ndarray, kept: list[tuple[int, int]], matches: list[int], k: int, price: int = 2) -> tuple[int, int, int, int, int]:
    """(start, end, start there, end there, words in common) of linked seeds, grown as far as both go on alike."""
    (p, h), (q, g) = kept[0], kept[-1]
    left = reach(a[:p][::-1], b[:h][::-1], price=price)
    right = reach(a[q + k :], b[g + k :], price=price)
    return p - left[0], q + k + right[0], h - left[1], g + k + right[1], k + sum(matches) + left[2] + right[2]


def aligned(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int) -> tuple[int, int, int, int, int]:
    """(start, end, start there, end there, words in common) of a whole chain, grown as far as both go on alike."""
    return grown(a, b, *links(a, b, chain, k), k)


def parts(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int, least: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """A chain as ``aligned`` gives it, where that is a passage; else the passages among its parts.

    The longest stretch of seeds with the identity is judged first, then what is left on both sides of it."""
    kept, matches = links(a, b, chain, k)
    whole = grown(a, b, kept, matches, k)
    if whole[4] >= identity * (whole[1] - whole[0]):
        return [whole] if whole[1] - whole[0] >= least else []
    at = np.array([p for p, _ in kept])
    # words in common less those that the identity asks for, up to each seed
    gain = np.concatenate([[0.0], np.cumsum(np.array(matches) - identity * np.diff(at))])
    out, open_ranges = [], [(0, len(kept))]
    while open_ranges:
        lo, hi = open_ranges.pop()
        if lo >= hi:
            continue
        # for each first seed, the last one up to which the identity holds
        later = np.maximum.accumulate(gain[lo:hi][::-1])
        last = hi - 1 - np.searchsorted(later, gain[lo:hi] - (1 - identity) * k - 1e-9)
        i = lo + int((at[last] - at[lo:hi]).argmax())
        j = int(last[i - lo])
        for price in (2, 8):  # 8: up to the first word that differs
            x = grown(a, b, kept[i : j + 1], matches[i:j], k, price)
            if x[4] >= identity * (x[1] - x[0]):
                if x[1] - x[0] >= least:
                    out.append(x)
                break
        open_ranges += [(lo, i), (j + 1, hi)]
    return out


def seeds(docs: DataFrame, k: int, window: int) -> DataFrame:
    """(seed, id, th, pos, plain): plain is the seed without its number, on later occurrences within a text only."""
    ddl = f"seed bigint, id {docs.schema['id'].dataType.simpleString()}, th bigint, pos int, plain bigint"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            found, n = [np.array([], np.uint64)], []
            plain, later = [np.array([], np.uint64)], [np.array([], bool)]
            places = [np.array([], np.int64)]
            for text in batch.column(2).to_pylist():
                words = word_hashes(text)
                kmers = shingle_hashes(words, k) if len(words) >= k else words[:0]
                at = winnowed(kmers, window)
                own, again = numbered(kmers[at])
                found.append(own)
                plain.append(kmers[at])
                later.append(again)
                places.append(at)
                n.append(len(at))
            row = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(plain).view(np.int64), mask=~np.concatenate(later))], schema=schema)

    return docs.select("id", "th", "text").mapInArrow(run, ddl)


def passages(df: DataFrame, *, k: int = 5, window: int = 12, least: int = 50, identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans): documents with passages of earlier ones. spans: (start, end, first_id, there, matches) in words, by start."""
    key, kind = key_of(df, id_col)
    docs = df.select(key.alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where("text is not null")
    rows = seeds(docs, k, window)
    doc = F.xxhash64("id", "th")
    first = rows.groupBy("seed").agg(F.min("id").alias("first_id"), F.min(doc).alias("lo"), F.max(doc).alias("hi"))
    first = written(first.where("lo <> hi").select("seed", "first_id"))
    shared = written(rows.join(first, "seed", "left").where("first_id is not null or plain is not null"))
    drop(first)
    # where that document holds the seed first
    there = written(shared.where("id = first_id").groupBy("seed").agg(F.min(F.struct("pos", "th")).alias("x"), F.first("first_id").alias("first_id")).select("seed", "first_id", F.col("x.pos").alias("there"), F.col("x.th").alias("first_th")))
    # occurrences beyond those that the first document of the seed has go with its first one as well
    own = shared.where("first_id is not null").select("seed", "id", "th", "pos", F.lit(None).cast(kind).alias("other"))
    beyond = shared.where("plain is not null").select(F.col("plain").alias("seed"), "id", "th", "pos", F.col("first_id").alias("other"))
    matches = own.union(beyond).join(there, "seed").where("(id <> first_id or th <> first_th) and (other is null or other <> first_id)")
    pairs = matches.groupBy("id", "th", "first_id", "first_th").agg(F.collect_list(F.struct("pos", "there")).alias("places")).where(F.size("places") > 1)
    ddl = f"id {kind}, th bigint, first_id {kind}, first_th bigint, chains array<array<struct<pos:int,there:int>>>"
    of_pair = ("id", "th", "first_id", "first_th")

    def chain():
        def of(batch):
            found = [[[{"pos": p, "there": h} for p, h in c] for c in chains([(x["pos"], x["there"]) for x in places])] for places in batch.column("places").to_pylist()]
            return {c: batch.column(c) for c in of_pair} | {"chains": found}

        return of

    chained = written(map_batches(pairs, chain, ddl).where(F.size("chains") > 0))
    drop(shared, there)

    needed = written(chained.select("id", "th").union(chained.select("first_id", "first_th")).distinct())
    few = needed.limit(BROADCAST + 1).count() <= BROADCAST
    texts = written(docs.join(F.broadcast(needed) if few else needed, ["id", "th"]).dropDuplicates(["id", "th"]))
    there_texts = texts.select(F.col("id").alias("first_id"), F.col("th").alias("first_th"), F.col("text").alias("there_text"))
    both = chained.join(texts, ["id", "th"]).join(there_texts, ["first_id", "first_th"])
    span = f"array<struct<start:int,end:int,first_id:{kind},there:int,matches:int>>"

    def align():
        hashes = Recent(word_hashes, 64).__getitem__

        def of(batch):
            out = []
            for first_id, found, text, there_text in zip(*(batch.column(c).to_pylist() for c in ("first_id", "chains", "text", "there_text")), strict=True):
                a, b = hashes(text), hashes(there_text)
                spans: list[dict] = []
                for c in found:
                    c = [(x["pos"], x["there"]) for x in c]
                    if any(s["start"] <= c[0][0] and c[-1][0] + k <= s["end"] for s in spans):
                        continue  # inside one that grew over it
                    for start, end, there, _, n in parts(a, b, c, k, least, identity):
                        if not any(s["start"] <= start and end <= s["end"] for s in spans):
                            spans.append({"start": start, "end": end, "first_id": first_id, "there": there, "matches": n})
                out.append(spans)
            return {"id": batch.column("id"), "th": batch.column("th"), "spans": out}

        return of

    found = map_batches(both.select("id", "th", "first_id", "chains", "text", "there_text"), align, f"id {kind}, th bigint, spans {span}").where(F.size("spans") > 0)
    # no more spans for a document than it has words
    out = written(found.groupBy("id", "th").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    drop(chained, needed, texts)
    return out


def union_of(spans: str):
    """Ranges (start, end) that the spans cover, apart from each other."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(out, x):
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] >= x["start"]), joined).otherwise(F.concat(out, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    return F.aggregate(F.col(spans), none, step)


def repeated_passages(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, n_passages, dup_words, passages), one row for each row: passages are start:end:first_id in words, end exclusive."""
    found = passages(df, id_col=id_col, text_col=text_col, **options)
    key, kind = key_of(df, id_col)
    rows = df.select(F.col(id_col).alias("_id"), key.alias("id"), F.xxhash64(text_col).alias("th"))
    covered = found.select("id", "th", "spans", union_of("spans").alias("ranges"))
    words = F.aggregate("ranges", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), shown(s["first_id"], kind))), ",")
    out = rows.join(covered.select("id", "th", F.size("spans").alias("n_passages"), words.alias("dup_words"), text.alias("passages")), ["id", "th"], "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_passages", F.lit(0)).cast("bigint").alias("n_passages"), F.coalesce("dup_words", F.lit(0)).cast("bigint").alias("dup_words"), F.coalesce("passages", F.lit("")).alias("passages"))


def without(text: str, ranges: list[dict]) -> str:
    """The text without the words of the ranges, and the white space after each."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for r in ranges:
        begin = at[r["start"]][0]
        out.append(text[last:begin])
        last = at[r["end"]][0] if r["end"] < len(at) else len(text)
    return "".join([*out, text[last:]])


def without_passages(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with repeated passages cut from its texts; rows whose text was nothing else keep an empty one. Columns stay as they are."""
    found = passages(df, id_col=id_col, text_col=text_col, **options)
    few = found.limit(BROADCAST + 1).count() <= BROADCAST
    own_id, own_th, own_ranges = fresh(df, "_id", "_th", "_ranges")
    ranges = found.select(F.col("id").alias(own_id), F.col("th").alias(own_th), union_of("spans").alias(own_ranges))
    same = (key_of(df, id_col)[0] == F.col(own_id)) & (F.xxhash64(F.col(text_col)) == F.col(own_th))
    joined = df.join(F.broadcast(ranges) if few else ranges, same, "left").drop(own_id, own_th)
    ddl, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), df.columns

    def make():
        def of(batch):
            texts = [t if not r or t is None else without(t, r) for t, r in zip(batch.column(text_col).to_pylist(), batch.column(own_ranges).to_pylist(), strict=True)]
            return {c: batch.column(c) for c in names} | {text_col: texts}

        return of

    return map_batches(joined, make, ddl)
