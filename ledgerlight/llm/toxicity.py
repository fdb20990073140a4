"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens get log-odds of toxic against other documents with an informative Dirichlet prior (the corpus' own token
frequencies, Monroe et al. 2008). A word whose log-odds stand out, or one of whose prefixes of 4 to 6 characters (inflected forms) stands
out, scores them. Every other word that ``least_docs`` training rows hold scores a step down plus its own log-odds, of which what speaks for
toxic is cut off below the step, since it may be chance; words seldom met cost the step. In each text the
linear-time scan of Ruzzo and Tompa (1999) then finds every maximal segment. Their scores are calibrated as extreme
values: the rate lambda solves sum p(s) exp(lambda s) = 1 over the scores of words in non-toxic documents, K fits
the tail of the segments seen there, a segment's expected number in a text of n words is E = K n exp(-lambda S), and the
sum of a text's segments above chance is turned into a probability by a logistic fit on the training rows.

Training rows: labelled rows of the given fold, at most ``most_rows`` of them (those with the smallest hash of their
id, a documented bound, which bounds the model too); everything is scored. Only texts are inputs of a score.

Nulls: null and empty texts have no words and get the lowest score there is. Null labels and ids don't train.
Repeated rows score alike; without any toxic training row all scores are 0. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import Recent, arrow_schema, drop, map_batches, words_of, written

STRIP = "\"'.,;:!?()[]{}*#$%&|<>-_"


def bare(word: str) -> str:
    return word.strip(STRIP).lower()


def forms(word: str) -> tuple[str, ...]:
    """The word itself and its prefixes, which stand for inflected forms."""
    w = bare(word)
    return (w, *(f"{w[:k]}~" for k in (6, 5, 4) if len(w) > k))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time."""
    found: list[list] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, r - left) for a, b, left, r in found]


@dataclass
class Model:
    """Log-odds of forms that stand out and of other words, and the calibration."""

    odds: dict[str, float] = field(default_factory=dict)
    others: dict[str, float] = field(default_factory=dict)
    step: float = -0.5
    lam: float = 1.0
    k: float = 1.0
    weight: float = 0.0
    bias: float = -20.0

    def word(self, word: str) -> float:
        every = forms(word)
        return next((self.odds[f] for f in every if f in self.odds), self.step + max(-2.0, min(-0.2 * self.step, self.others.get(every[0], 0.0))))

    def passages(self, scores: list[float]) -> list[tuple[int, int, float, float]]:
        """Segments with E: how many as good are expected by chance in a text of this length."""
        return [(a, b, s, self.k * len(scores) * math.exp(-self.lam * s)) for a, b, s in segments(scores)]

    def strength(self, scores: list[float]) -> float:
        """Sum of -log E over the segments rarer than chance: grows with each significant passage."""
        return sum(-math.log(e + 1e-300) for *_, e in self.passages(scores) if e < 1)

    def score(self, strength: float) -> float:
        x = self.bias + self.weight * math.log1p(strength)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def in_fold(id_col: Column, folds: int) -> Column:
    """True for rows held out of training."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, *, folds: int = 5, most_rows: int = 40_000, least_docs: int = 5, prior: float = 0.1, least_z: float = 4.0, least_odds: float = 2.0, least_types: int = 6, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from at most most_rows labelled rows outside the held-out fold; the model has the words that least_docs of them hold, and forms that stand out."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~F.coalesce(in_fold(F.col("id"), folds), F.lit(True)))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # copies of a text train once; at most most_rows short rows
    known = written(texts.join(F.broadcast(known), "id").groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min("id").alias("id")).select("id", "y"))
    rows = texts.join(F.broadcast(known), "id").select("text", "y")

    schema = arrow_schema("form string, y int, n bigint")

    def count(batches):
        seen, of = {0: Counter(), 1: Counter()}, Recent(bare).__getitem__
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # once a document: a text that repeats a word says no more
                seen[y].update({of(w) for w in set(words_of(text or ""))} - {""})
        for y, out in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array([y] * len(out), pa.int32()), pa.array(out.values(), pa.int64())], schema=schema)

    words = written(rows.mapInArrow(count, "form string, y int, n bigint").groupBy("form").agg(F.sum(F.expr("n * y")).alias("n1"), F.sum(F.expr("n * (1 - y)")).alias("n0")))
    t1, t0 = words.agg(F.sum("n1"), F.sum("n0")).first()
    if not t1 or not t0:
        return Model()

    def weighed(table: DataFrame) -> DataFrame:
        """d, the smoothed log-odds, and z, how far they are from chance."""
        # the prior: `prior` times the corpus' own counts
        alpha, mass = F.lit(prior) * (F.col("n1") + F.col("n0")), prior * (t1 + t0)
        a1, a0 = F.col("n1") + alpha, F.col("n0") + alpha
        delta = F.log(a1 / (F.lit(float(t1 + mass)) - a1)) - F.log(a0 / (F.lit(float(t0 + mass)) - a0))
        return table.withColumns({"d": delta, "z": delta / F.sqrt(1 / a1 + 1 / a0)})

    out = (F.col("z") >= least_z) & (F.col("d") >= least_odds)
    own = written(weighed(words).where(out | (F.col("n1") + F.col("n0") >= least_docs)).select("form", "d", out.alias("out")))
    # prefixes count the words that don't stand out themselves, and only where many words share one
    rest = words.join(own.where("out").select("form"), "form", "left_anti").select(F.explode(F.transform(F.array(*map(F.lit, (4, 5, 6))), lambda k: F.when(F.length("form") > k, F.concat(F.substring(F.col("form"), F.lit(1), k), F.lit("~"))))).alias("form"), "n1", "n0").where("form is not null")
    stems = weighed(rest.groupBy("form").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count(F.lit(1)).alias("types")).where(F.col("types") >= least_types)).where(out).select("form", "d")
    # no more forms than most_rows texts hold
    model = Model({r.form: float(r.d) for r in own.where("out").select("form", "d").union(stems).toLocalIterator()}, {r.form: float(r.d) for r in own.where("not out").toLocalIterator()})
    drop(words, own)
    model = calibrated(model, rows, spark)
    drop(known)
    return model


def tail_factor(segs: dict[float, int], total: int, lam: float, share: float = 0.25) -> float:
    """K, so that K * total * exp(-lam * S) is the number of background segments that score S or more, at the S that the best ``share`` of them reach.

    Without background segments there is one at most: K is that of one segment of the least score."""
    seen, t = 0, 0.0
    for t in sorted(segs, reverse=True):
        seen += segs[t]
        if seen >= max(10, share * sum(segs.values())):
            break
    return max(1e-9, min(10.0, max(seen, 1) * math.exp(min(600.0, lam * t)) / total))


def calibrated(model: Model, rows: DataFrame, spark) -> Model:
    """lambda and K from words and segments of non-toxic rows, the logistic curve from all training rows."""
    shared = spark.sparkContext.broadcast(model)
    ddl = "y int, n bigint, value double, kind int"
    schema = arrow_schema(ddl)

    def look(batches):
        m = shared.value
        score, hist, segs, n0 = Recent(m.word).__getitem__, Counter(), Counter(), 0
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if y == 0:
                    s = [score(w) for w in words_of(text or "")]
                    n0 += len(s)
                    hist.update(round(x, 1) for x in s)
                    segs.update(round(x[2], 1) for x in segments(s))
        out = [(0, n, v, 0) for v, n in hist.items()] + [(0, n, v, 1) for v, n in segs.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    seen = rows.mapInArrow(look, ddl).groupBy("kind", "value").agg(F.sum("n").alias("n")).collect()  # rounded scores: a few hundred rows
    hist = {r.value: r.n for r in seen if r.kind == 0}
    segs = {r.value: r.n for r in seen if r.kind == 1}
    total = sum(hist.values()) or 1
    top = max([1.0, *model.odds.values()])
    p = {v: n / (total + 1) for v, n in hist.items()} | ({} if any(v > 0 for v in hist) else {top: 1 / (total + 1)})
    grow = lambda lam: sum(q * math.exp(min(700.0, lam * v)) for v, q in p.items()) - 1
    lo, hi = 1e-6, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if grow(mid) < 0 else (lo, mid)
    model.lam = max(0.05, (lo + hi) / 2)
    model.k = tail_factor(segs, total, model.lam)
    shared = spark.sparkContext.broadcast(model)

    def make():
        m = shared.value
        score = Recent(m.word).__getitem__
        return lambda batch: {"y": batch.column(1), "s": [m.strength([score(w) for w in words_of(t or "")]) for t in batch.column(0).to_pylist()]}

    # rounded strengths: the pairs to fit are counts, bounded by most_rows
    got = map_batches(rows, make, "y int, s double").groupBy("y", F.round(F.log1p("s"), 2).alias("x")).count().collect()
    y, x, n = (np.array([r[k] for r in got], float) for k in ("y", "x", "count"))
    w, b = 1.0, -1.0
    for _ in range(60):  # Newton steps of a logistic fit with a small ridge
        q = 1 / (1 + np.exp(-np.clip(b + w * x, -30, 30)))
        g = np.array([(n * (q - y)).sum() + 0.01 * b, (n * (q - y) * x).sum() + 0.01 * w])
        v = n * q * (1 - q)
        h = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        d = np.linalg.solve(h, g)
        b, w = b - d[0], w - d[1]
        if abs(d).max() < 1e-9:
            break
    model.weight, model.bias = float(max(w, 0.0)), float(b)
    return model


def scored(docs: DataFrame, model: Model, *, folds: int = 5, significant: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted, n_passages, passages): passages are word ranges start:end with E up to ``significant``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        m = shared.value
        of_word = Recent(m.word).__getitem__

        def of(batch):
            score, n, spans = [], [], []
            for t in batch.column(2).to_pylist():
                s = list(map(of_word, words_of(t or "")))
                score.append(m.score(m.strength(s)) if m.weight else 0.0)
                found = [(a, b) for a, b, _, e in m.passages(s) if e <= significant]
                n.append(len(found))
                spans.append(",".join(f"{a}:{b}" for a, b in found))
            return {id_col: batch.column(0), "held_out": batch.column(1), "score": score, "predicted": [int(x >= 0.5) for x in score], "n_passages": n, "passages": spans}

        return of

    return map_batches(docs.select(F.col(id_col), F.coalesce(in_fold(F.col(id_col), folds), F.lit(False)).alias("held_out"), F.col(text_col)), make, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, n_passages int, passages string")
