"""Quality rules with limits that follow the corpus.

Each document gives a few whole-number measures. A quantile sketch of each measure for each language and source is a
log-linear histogram: values keep their leading 6 bits, so a quantile is off by 1/32 of itself at most, sketches
merge by adding counts, and the same table always gives the same limits. The limits of a group are Tukey fences on
its sketch, with a least width; a group of fewer than ``least`` documents takes its language's merged sketch, and a
small language that of the corpus. Documents are then joined with their group's limits.

Nulls: a null text has no words and fails the base rules; null languages and sources are groups of their own.
Repeated rows are judged alike; an empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import WORD, map_batches, words_of, written

SYMBOLS = "#*$%&|<>"
#: Measure, and the least distance of a limit from the quartiles. The first four have an upper limit, the last both.
MEASURES = {"symbol_rate": 250, "repeat_rate": 400, "dup_word_rate": 300, "upper_rate": 250, "word_length": 200}
#: A sketch holds no more counts than this for a group; groups up to GROUPS are broadcast, more are joined with salt.
GROUPS = 50_000


def measures_of(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_dup_words, n_upper"""
    if not text:
        return (0,) * 7
    words = words_of(text)
    lines = Counter(text.split("\n"))
    for x in [x for x in lines if not WORD.search(x)]:
        del lines[x]
    dup = sum(lines.values()) - len(lines)
    dup_words = sum(len(words_of(x)) * (k - 1) for x, k in lines.items() if k > 1)
    upper = sum(len(w) > 1 for w in words if w.isupper())
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated(words), dup_words, upper


def repeated(words: list[str]) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    m = len(ids)
    if m == n:
        return 0
    if m < 2_000_000:
        windows = (x[:-2] * m + x[1:-1]) * m + x[2:]
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    else:  # three numbers don't fit into 64 bits
        _, back, count = np.unique(np.stack([x[:-2], x[1:-1], x[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    twice = count[back.ravel()] > 1
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i : n - 2 + i] |= twice
    return int(inside.sum())


def measures(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_dup_words", "n_upper")

    def make():
        def of(batch):
            got = np.array([measures_of(t) for t in batch.column(1).to_pylist()], np.int64)
            return {id_col: batch.column(0), "lang": batch.column(2), "source": batch.column(3)} | {n: got[:, i] for i, n in enumerate(names)}

        return of

    rows = map_batches(df.select(F.col(id_col), F.col(text_col), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")), make, f"`{id_col}` {kind}, lang string, source string, " + ", ".join(f"{n} bigint" for n in names))
    per = lambda a, b, k=1000: F.when(F.col(b) > 0, F.floor(F.col(a) * k / F.col(b))).otherwise(0).cast("bigint")
    return rows.withColumns({"symbol_rate": per("n_symbols", "n_words"), "repeat_rate": per("n_repeat_words", "n_words"), "dup_word_rate": per("n_dup_words", "n_words"), "upper_rate": per("n_upper", "n_words"), "word_length": per("word_chars", "n_words", 100)})


def bucket(value: Column) -> Column:
    """The value with all but its leading 6 bits cleared: the key of its histogram bucket."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame, names: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """(lang, source, measure, low, n): mergeable by summing n."""
    long = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), bucket(F.col(n)).alias("low")) for n in names])).alias("m"))
    return long.groupBy("lang", "source", "m.measure", "m.low").agg(F.count(F.lit(1)).alias("n"))


def merged_quantiles(sketch: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles of sketches merged for each (lang, source), lang, and all: level 0, 1 and 2."""
    merged = sketch.select("lang", "source", "measure", "low", "n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level")).select(F.when(F.col("level") < 2, F.col("lang")).alias("lang"), F.when(F.col("level") < 1, F.col("source")).alias("source"), "level", "measure", "low", "n")
    merged = merged.groupBy("level", "lang", "source", "measure", "low").agg(F.sum("n").alias("n"))
    # a group's histogram is bounded: 32 buckets for each power of two
    counts = F.sort_array(F.collect_list(F.struct("low", "n")))
    hist = merged.groupBy("level", "lang", "source", "measure").agg(counts.alias("h"), F.sum("n").alias("total"))

    def quantile(q: float) -> Column:
        return F.aggregate("h", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at")), lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["at"].isNull() & (s["seen"] + x["n"] >= q * F.col("total")), x["low"]).otherwise(s["at"]).alias("at")))["at"]

    return hist.select("level", "lang", "source", "measure", "total", *[quantile(q).alias(n) for n, q in quantiles.items()])


def limits(sketch: DataFrame, *, least: int = 200, factor: int = 3) -> DataFrame:
    """One row for each (lang, source): <measure>_high, and word_length_low."""
    q = merged_quantiles(sketch, {"q1": 0.25, "q3": 0.75})
    width = F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv])
    spread = (F.col("q3") - F.col("q1")) * factor + width[F.col("measure")]
    fences = q.select("level", "lang", "source", "total", F.struct("measure", (F.col("q3") + spread).alias("high"), (F.col("q1") - spread).alias("low")).alias("f"))
    one = lambda kind, m: F.max(F.when(F.col("f.measure") == m, F.col(f"f.{kind}"))).alias(f"{m}_{kind}")
    wide = fences.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *[one("high", m) for m in MEASURES], one("low", "word_length"))
    cols = [*[f"{m}_high" for m in MEASURES], "word_length_low"]
    wide = written(wide)
    own = wide.where("level = 0").alias("g")
    by_lang = wide.where("level = 1").select(F.col("lang").alias("l_lang"), F.col("total").alias("l_total"), *[F.col(c).alias(f"l_{c}") for c in cols])
    of_all = wide.where("level = 2").select(*[F.col(c).alias(f"a_{c}") for c in cols])  # a single row
    joined = own.join(by_lang, own["lang"].eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(of_all), F.lit(True), "left")
    return joined.select("lang", "source", *[F.when(F.col("total") >= least, F.col(c)).when(F.col("l_total") >= least, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in cols])


def with_limits(measured: DataFrame, limit: DataFrame) -> DataFrame:
    """Joins each document with its group's limits. Few groups are broadcast; many are joined on the group and a salt."""
    limit = written(limit)
    few = limit.limit(GROUPS + 1).count() <= GROUPS
    limit = limit.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    same = measured["lang"].eqNullSafe(F.col("g_lang")) & measured["source"].eqNullSafe(F.col("g_source"))
    if few:
        return measured.join(F.broadcast(limit), same, "left")
    salts = 64
    salted = measured.withColumn("salt", F.pmod(F.xxhash64(*measured.columns), F.lit(salts)))
    return salted.join(limit.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), same & (F.col("salt") == F.col("g_salt")), "left").drop("salt", "g_salt")


def judged(df: DataFrame, *, id_col: str = "doc_id", least: int = 200, factor: int = 3, **cols: str) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons)"""
    measured = written(measures(df, id_col=id_col, **cols))
    joined = with_limits(measured, limits(sketches(measured), least=least, factor=factor))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = [F.when(F.col(m) > F.col(f"{m}_high"), F.lit(m)) for m in MEASURES] + [F.when(F.col("word_length") < F.col("word_length_low"), F.lit("word_length"))]
    out = joined.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.array_compact(F.array(*over)).alias("over"))
    return out.select(*out.columns[:-1], (~F.col("base_failed") & (F.size("over") == 0)).alias("kept"), F.array_join("over", ",").alias("reasons"))
