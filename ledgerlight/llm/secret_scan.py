"""Secret scan in DataFrame functions: patterns, and character Markov models for strings no pattern names.

Two first-order character models are trained from labelled samples: random strings (base64, its URL form, letters and
digits in several cases, hexadecimal), made by rule from hashes, and ordinary identifiers (words joined in the usual ways, paths, dates,
numbers), made by rule from a list of words, together with the plain words of a bounded sample of the texts. What the
texts hold of secrets is no part of either, so recall doesn't fall as secrets become more. A table of labelled strings
may be given instead.

Candidates are runs of 16 or more of ``A-Za-z0-9+/_=-``. Along each, the log-likelihood ratios of neighbouring characters are summed
up; every stretch whose sum reaches ``least_total`` with a mean of ``least_mean`` is a secret, grown to the letters and digits
that adjoin it, so a random part of a path or of a longer name is found as well. Those that overlap a base span
add nothing. The models are tables of a fixed size (one number for each pair of symbols). Spans are in code points, end exclusive.

Everything stays in the JVM: matches come from regexp_extract_all, their places from the gaps that split leaves.

Nulls: a null text is empty: no spans. Rows are scanned one by one, so repeated rows repeat; an empty table gives an
empty result. Columns of the input other than the named ones aren't looked at.
Where spans start together, they are ordered by kind as in KINDS.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run that is too short holds no match that is long enough, so the length can stand in the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Small letters, capitals, digits, and each mark on its own.
CLASSES = ["A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in ALPHABET]
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Words that identifiers of the labelled sample are made of.
WORDS = (
    "access account action address agent amount array author base batch block body branch buffer build cache call category change channel chart check child class client code column config content context count create current "
    "customer data date default delete detail device district document domain editor email engine entry error event export factory field file filter first folder format frame group handler header history home host image import "
    "index info input insert item job key label language last layer level library limit line list local location manager map market member message method model module month name network node notice number object office option "
    "order output owner package page parent parser path payment people percent place policy port position private product profile project public query queue range read record region report request resource response result role "
    "root row sample schema score search section select server service session setting shape sheet size sort source stage start state status storage stream string style summary support system table target task template test "
    "text thread time title total trace transfer tree type union update upload user value vector version view widget window work worker write year zone"
).split()
#: Prefix sums are taken in blocks of so many matches, so that long texts cost in proportion.
BLOCK = 256


def running(items: Column, step, empty: Column) -> Column:
    """Results of step(at, item) = (next at, array) along items, from 0; arrays are joined."""

    def inner(start: Column, block: Column, finish) -> Column:
        def one(s: Column, x: Column) -> Column:
            at, out = step(s["at"], x)
            return F.struct(at.alias("at"), F.concat(s["out"], out).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), empty.alias("out")), one, finish)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    outer = F.struct(F.lit(0).alias("at"), F.slice(F.array(empty), 1, 0).alias("out"))
    done = F.aggregate(blocks, outer, lambda s, block: inner(s["at"], block, lambda z: F.struct(z["at"].alias("at"), F.concat(s["out"], F.array(z["out"])).alias("out"))))
    return F.flatten(done["out"])


def located(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """Spans of all matches, leftmost and without overlap; with group, those whose group has ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    lengths = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("n"), F.transform(inner, lambda m: F.length(m)).alias("own"))
    none = F.array().cast(SPAN)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + F.coalesce(x["n"], F.lit(0))
        return end, F.when(x["own"] >= least, F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).otherwise(none)

    # most texts hold no match: they are read once
    return F.when(text.rlike(pattern), let(lengths, lambda rows: running(rows, step, none))).otherwise(none)


def let(value: Column, of) -> Column:
    """of(value), with value worked out once."""
    return F.transform(F.array(value), of)[0]


def base_spans(text: Column) -> Column:
    return F.concat(located(text, ASSIGN, 0, 2, 6), located(text, ACCESS, 1, None, 1), located(text, HEX, 2, None, 1))


def random_strings(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(token): n random strings of 20 to 44 characters in the usual alphabets, from hashes of their numbers."""
    digest = F.base64(F.unhex(F.sha2(F.concat_ws(":", F.lit(f"random {seed}"), F.col("id")), 512)))
    plain = F.translate(digest, "+/=", "")
    kinds = [F.regexp_replace(digest, "=", ""), plain, plain, F.translate(F.regexp_replace(digest, "=", ""), "+/", "-_"), F.lower(plain), F.upper(plain), F.sha2(digest, 256)]
    at = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most)).cast("int")
    return spark.range(n).select(F.substring(F.get(F.array(*kinds), at("kind", len(kinds))), F.lit(1), 20 + at("length", 25)).alias("token"))


def identifiers(spark: SparkSession, n: int, seed: int = 0, words=WORDS) -> DataFrame:
    """(token): n ordinary identifiers: words joined in the usual ways, with and without numbers, paths, dates and numbers."""
    at = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(f"{seed} {salt}")), F.lit(most)).cast("int")
    w = [F.get(F.array(*map(F.lit, words)), at(f"word {i}", len(words))) for i in range(4)]
    number, long = at("number", 3000).cast("string"), F.lpad(F.abs(F.xxhash64("id", F.lit(f"{seed} long"))).cast("string"), 19, "0")
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), at("day", 15_000)), "yyyy-MM-dd")
    capital, few = [F.initcap(x) for x in w], F.slice(F.array(*w), F.lit(1), 2 + at("few", 3))
    kinds = [
        F.concat(*w[:3]), F.array_join(few, "_"), F.array_join(few, "-"), F.concat(w[0], *capital[1:]), F.concat(*capital), F.upper(F.array_join(few, "_")), F.array_join(few, "/"), F.concat(F.lit("/"), F.array_join(few, "/"), F.lit("/"), w[3]),
        F.concat(F.array_join(few, "_"), F.lit("_"), number), F.concat(F.array_join(few, "-"), F.lit("-"), day), F.concat(F.concat(*w[:2]), number), F.substring(long, F.lit(1), 10 + at("digits", 10)), F.concat(day, F.lit("-"), number), F.concat(w[0], F.lit("="), capital[1], F.lit("-"), number),
        F.concat(w[0], F.lit("/"), number, F.lit("/"), at("month", 13).cast("string"), F.lit("/"), w[1], F.lit("-"), w[2]), F.concat(w[0], at("two", 100).cast("string"), w[1], at("one", 10).cast("string"), w[2]), F.concat(w[0], capital[1], at("one", 10).cast("string"), capital[2], at("two", 100).cast("string"), capital[3]),
        F.concat(w[0], F.lit("/v"), at("one", 10).cast("string"), F.lit("/"), capital[1], capital[2], F.lit("/"), number), F.concat(F.upper(w[0]), F.lit("-"), number, F.lit("-"), F.upper(w[1])), F.concat(F.lit("get"), capital[0], F.upper(F.substring(w[1], 1, 3)), capital[2]), F.concat(day, F.lit("/"), w[0], F.lit("_"), F.translate(day, "-", "")),
    ]
    return spark.range(n).select(F.get(F.array(*kinds), at("kind", len(kinds))).alias("token"))


def plain_words(df: DataFrame, most_docs: int, text_col: str) -> DataFrame:
    """(token): the distinct words of letters only, of 3 to 20, in the ``most_docs`` texts of the smallest hashes: a sample to train on, the same one however rows are dealt."""
    every = max(1, -(-df.count() // (2 * most_docs)))
    rows = df.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where(F.pmod("h", F.lit(every)) == 0).orderBy("h", "text").limit(most_docs)
    return rows.select(F.explode(F.split("text", r"[\s.,;:!?()]+")).alias("token")).where(F.col("token").rlike("^[A-Z]?[a-z]{2,19}$")).distinct()


def samples(df: DataFrame, *, n: int = 12_000, most_docs: int = 2000, text_col: str = "text") -> DataFrame:
    """(kind, random, token): the labelled samples."""
    spark = df.sparkSession
    parts = [("strings", True, random_strings(spark, n)), ("identifiers", False, identifiers(spark, n)), ("words", False, plain_words(df, most_docs, text_col))]
    named = [rows.select(F.lit(kind).alias("kind"), F.lit(y).alias("random"), "token") for kind, y, rows in parts]
    return named[0].unionAll(named[1]).unionAll(named[2])


def codes(token: Column) -> Column:
    """Places of the characters in ALPHABET, from 1. Words in capitals only are read in small letters."""
    read = F.when(token.rlike("^[A-Z/_=+-]+$"), F.lower(token)).otherwise(token)
    return F.transform(F.split(read, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(labelled: DataFrame, *, pull: float = 600.0, total: float = 100_000.0) -> list[float]:
    """log p(b|a) of random strings less that of ordinary identifiers, for each pair of symbols, from (kind, random, token).

    Each kind of sample counts as ``total`` pairs; with weight ``pull`` a pair backs off to the step between the classes of its
    symbols, and the share of the symbol in its class. Table sizes are fixed."""
    x = labelled.select("kind", "random", codes(F.col("token")).alias("x"))
    pairs = x.select("kind", "random", F.explode(F.arrays_zip(F.slice("x", F.lit(1), F.size("x") - 1).alias("a"), F.slice("x", F.lit(2), F.size("x")).alias("b"))).alias("p"))
    counts = pairs.groupBy("kind", "random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("a > 0 and b > 0").collect()
    of_kind: dict[str, int] = {}
    for r in counts:
        of_kind[r.kind] = of_kind.get(r.kind, 0) + r.n
    size = len(ALPHABET)

    def model(random: bool) -> list[float]:
        n = [[0.0] * size for _ in range(size)]
        for r in counts:
            if r.random == random:
                n[r.a - 1][r.b - 1] += r.n * total / of_kind[r.kind]
        one = [sum(col) + 1.0 for col in zip(*n, strict=True)]
        classes = sorted(set(CLASSES))
        step = {c: {d: 1.0 + sum(n[a][b] for a in range(size) if CLASSES[a] == c for b in range(size) if CLASSES[b] == d) for d in classes} for c in classes}
        whole = {d: sum(one[b] for b in range(size) if CLASSES[b] == d) for d in classes}
        out = []
        for a in range(size):
            c = CLASSES[a]
            for b in range(size):
                back = step[c][CLASSES[b]] / sum(step[c].values()) * one[b] / whole[CLASSES[b]]
                out.append(math.log((n[a][b] + pull * back) / (sum(n[a]) + pull)))
        return out

    return [x - y for x, y in zip(model(True), model(False), strict=True)]


def stretches(token: Column, ratios: list[float], least: float, drop: float) -> Column:
    """(start, end, score) of the stretches of a string whose ratios sum up to ``least``; a stretch ends where its sum falls to nothing, or by ``drop``."""
    # one literal, folded once: no row-by-row lookups outside the JVM
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    ratio = lambda a, b: F.when((a > 0) & (b > 0), F.get(table, (a - 1) * len(ALPHABET) + b - 1)).otherwise(0.0)
    of_pairs = let(codes(token), lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), ratio))
    done = lambda s: F.when(s["best"] >= least, F.concat(s["out"], F.array(F.struct(s["begin"].alias("start"), s["end"].alias("end"), s["best"].alias("score"))))).otherwise(s["out"])

    def step(s: Column, r: Column) -> Column:
        total = s["sum"] + r
        over = (total <= 0) | (s["best"] - total > drop)
        higher = total > s["best"]
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(over, 0.0).otherwise(total).alias("sum"), F.when(over, s["at"] + 1).otherwise(s["begin"]).alias("begin"),
            F.when(over, 0.0).when(higher, total).otherwise(s["best"]).alias("best"), F.when(over, s["at"] + 1).when(higher, s["at"] + 2).otherwise(s["end"]).alias("end"), F.when(over, done(s)).otherwise(s["out"]).alias("out"),
        )

    zero = F.lit(0)
    start = F.struct(zero.alias("at"), F.lit(0.0).alias("sum"), zero.alias("begin"), F.lit(0.0).alias("best"), zero.alias("end"), none.alias("out"))
    return F.aggregate(of_pairs, start, step, done)


def added(text: Column, found: Column, base: Column, ratios: list[float], least_total: float, least_mean: float, least_length: int, drop: float) -> Column:
    """Spans that the models add among the candidates found."""

    def of(c: Column) -> Column:
        def in_token(token: Column) -> Column:
            def grown(x: Column) -> Column:
                left = F.length(F.regexp_extract(F.substring(token, F.lit(1), x["start"]), "[A-Za-z0-9]*$", 0))
                right = F.length(F.regexp_extract(F.substring(token, x["end"] + 1, F.length(token)), "^[A-Za-z0-9]*=*", 0))
                return F.struct((c["start"] + x["start"] - left).alias("start"), c["kind"].alias("kind"), (c["start"] + x["end"] + right).alias("end"))

            high = F.filter(stretches(token, ratios, least_total, drop), lambda x: x["score"] >= least_mean * (x["end"] - x["start"] - 1))
            return F.transform(high, grown)

        return let(F.substring(text, c["start"] + 1, c["end"] - c["start"]), in_token)

    spans = F.array_distinct(F.flatten(F.transform(found, of)))
    apart = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return F.filter(spans, lambda c: (c["end"] - c["start"] >= least_length) & apart(c))


def scan(df: DataFrame, *, labelled: DataFrame | None = None, least_total: float = 16.0, least_mean: float = 0.6, least_length: int = 16, drop: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, base, spans): arrays of (start, kind, end) in order, kind as a place in KINDS; spans holds base and the strings the models add.

    labelled: (kind, random, token) to train from, in place of ``samples``."""
    ratios = train(samples(df, text_col=text_col) if labelled is None else labelled)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", base_spans(F.col("text")).alias("base"), located(F.col("text"), CANDIDATE, 3, None, 1).alias("found"))
    more = F.when(F.size("found") > 0, added(F.col("text"), F.col("found"), F.col("base"), ratios, least_total, least_mean, least_length, drop)).otherwise(F.array().cast(SPAN))
    return rows.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.array_sort("base").alias("base"), F.array_sort(F.concat("base", more)).alias("spans"))


def as_text(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return scanned.select(id_col, *[n(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def masked(scanned: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> Column:
    """The text with each secret replaced; spans that overlap become one mark."""
    text = F.col(text_col)

    # for each span, the part of the text before it, where it isn't inside what came before
    def step(at: Column, x: Column) -> tuple[Column, Column]:
        before = F.concat(F.substring(text, at + 1, x["start"] - at), F.lit(mark))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.array(before)).otherwise(F.array().cast("array<string>"))

    # spans are in order: the last end of all is the largest
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    done = F.concat(F.array_join(running(F.col("spans"), step, F.array().cast("array<string>")), ""), F.substring(text, last + 1, F.length(text)))
    return F.when(F.size("spans") > 0, done).otherwise(text)
