"""Chat formatting: transcripts are parsed into turns, a hidden Markov model recovers their roles, then one canonical form.

A row's text may hold one turn or a whole transcript. It is cut at lines that open with a speaker marker (``User:``,
``### Assistant``, ``<|im_start|>system``, ``[TOOL]``, ``**Bot:**`` and the like), but not inside code fences or quotes. A word and a colon alone may
as well be a label in a form ("Model: X100"), so further on in a row it counts only where the row supports it: the same word
comes again with another speaker between, or the row opens with a speaker and all its words go together as speakers do. Hidden states are
the roles. A part's observations are whom its marker names, if it has one, and features of its lines: its length, its line
count, a question mark, code or lists, a leading instruction word, and whether it opens the conversation. Start, transition and
emission tables are learned by counting on labelled rows of one part in the training folds; a marker names its own role by a prior of
``trust`` counts, which labelled markers add to, so that markers are understood where no labelled row has any. Viterbi then finds the likeliest roles of
each whole conversation. A marker goes only where the role found is the one it names, and turns are rendered with the role instead; it stays
as text where its part goes on with the role of the part before it in the row, where the role found is another, and where a lone label that is an
ordinary noun is the only marker of its conversation. So no text is lost.

A conversation may be of any length: it is cut into blocks, a block is reduced to a matrix of best scores from each
state to each state (max-plus products), blocks are joined level by level in the same way, and the path goes down again, so
no task ever holds more than a block, and the result is the same as one pass over the whole.

Nulls: turns with a null conversation are conversations of one row each; a null turn comes first; a null text is
empty; null and unknown roles don't train. Texts of any length are whole, and other columns are ignored, whatever their names. Rows of one turn number are in the order of a hash of their text, then by role; repeated
rows are turns of their own. Turns that aren't whole numbers come first, in their own order. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import arrow_schema, drop, written

ROLES = ("system", "user", "assistant", "tool")
#: What markers say; fixed values.
SPEAKERS = {"system": 0, "user": 1, "human": 1, "customer": 1, "question": 1, "q": 1, "prompt": 1, "instruction": 1, "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "agent": 2, "answer": 2, "a": 2, "response": 2, "tool": 3, "function": 3, "observation": 3}
#: Words that stand for speakers together: whose of users go with whose of assistants; fixed values.
PARTNERS = {
    "user": ("assistant", "ai", "bot", "gpt", "model"), "human": ("assistant", "ai", "bot", "gpt", "model"), "customer": ("agent", "assistant", "ai", "bot"), "question": ("answer", "a"), "q": ("answer", "a"),
    "prompt": ("response", "answer", "model"), "instruction": ("response", "answer", "assistant"),
}
#: Words that are hardly anything but speakers.
CLEAR = ("system", "user", "human", "assistant")
_WHO = "(?:" + "|".join(SPEAKERS) + ")"
#: A marker at the start of a text may be a bare line; further on it has to be set off.
MARKER = re.compile(rf"\s*(?:#{{1,4}}\s*|<\|?(?:im_start\|>)?\s*|\[|\*\*)?({_WHO})\s*(?:\|?>|\]|\*\*)?\s*(?::\*\*|:|\n|\|?>)\s*", re.I)
LATER = re.compile(rf"^[ \t]*(?:#{{1,4}}[ \t]*{_WHO}[ \t]*:?[ \t]*$|<\|im_start\|>[ \t]*{_WHO}\b|<\|?{_WHO}\|?>|\[{_WHO}\]:?|\*\*{_WHO}:?\*\*:?|{_WHO}[ \t]*:)\s*", re.I | re.M)
FENCE = re.compile(r"^[ \t]*```", re.M)
CLOSED = re.compile(r"\s*<\|(?:im_end|end|eot_id|endoftext)\|>\s*$")
NAMED = re.compile(_WHO, re.I)
#: Sizes of the features: whom the marker names (none or a role), length, lines, question, block, instruction, opening.
SIZES = (5, 8, 4, 2, 2, 2, 2)


def speaker(marker: str) -> str | None:
    found = NAMED.search(marker.replace("im_start", ""))
    return found[0].lower() if found else None


def is_plain(marker: str) -> bool:
    """A word and a colon, or a line break, without anything that sets it off."""
    return marker.lstrip()[:1].isalpha()


def partners(a: str, b: str) -> bool:
    return b in PARTNERS.get(a, ()) or a in PARTNERS.get(b, ())


def supported(words: list[str], opens: bool) -> set[str]:
    """Of the speakers' words of a row, in order, those that count as speakers without being set off. opens: the first stands at the row's start."""
    last, again = {}, set()
    for i, w in enumerate(words):
        # the same word again, with another role since
        if w in last and any(SPEAKERS[x] != SPEAKERS[w] for x in words[last[w] + 1 : i]):
            again.add(w)
        last[w] = i
    if again:
        return again | {"system"} | {w for w in last if any(partners(w, x) for x in again)}
    users, others = ({w for w in last if SPEAKERS[w] == role} for role in (1, 2))
    turns = [SPEAKERS[w] for w in words if SPEAKERS[w] in (1, 2)]
    together = users and others and all(partners(a, b) for a in users for b in others)
    return {*users, *others, "system"} if opens and together and all(a != b for a, b in zip(turns, turns[1:])) else set()


def parts(text: str) -> list[tuple[str, str]]:
    """(marker, body) of each turn in a text, in order; joined, they are the text again."""
    fences = [m.start() for m in FENCE.finditer(text)]
    first = MARKER.match(text) or LATER.match(text)
    begin = first.end() if first else 0
    cuts = [m for m in LATER.finditer(text) if m.start() >= max(1, begin) and bisect_left(fences, m.start()) % 2 == 0]
    words = [speaker(m[0]) for m in ([first] if first else []) + cuts]
    ok = supported(words, first is not None) if any(is_plain(m[0]) for m in cuts) else set()
    spans = [(0, begin), *(m.span() for m in cuts if not is_plain(m[0]) or speaker(m[0]) in ok)]
    return [(text[a:b], text[b:end]) for (a, b), end in zip(spans, [*(a for a, _ in spans[1:]), len(text)], strict=True)]


def features(marker: str, body: str) -> list[int]:
    """All but the last of SIZES."""
    lines = body.strip().count("\n")
    who = speaker(marker)
    return [
        SPEAKERS[who] + 1 if who else 0,
        min(7, max(0, len(body.strip()).bit_length() - 3)),
        min(3, lines.bit_length()),
        int(body.rstrip().endswith("?")),
        int("```" in body or bool(re.search(r"(?m)^\s*(?:[-*]|\d+\.) ", body))),
        int(bool(re.match(r"(?i)\s*(?:you are|you're|act as|always|never|follow)\b", body))),
    ]


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    @property
    def steps(self) -> np.ndarray:
        """step, and one state more that a conversation starts in and never comes back to."""
        return np.column_stack([np.vstack([self.step, self.start]), np.full(len(ROLES) + 1, -math.inf)])

    def scores(self, observed: np.ndarray) -> np.ndarray:
        """Log-likelihood of each turn under each state."""
        roles = sum(e[:, observed[:, k]] for k, e in enumerate(self.emit)).T
        return np.column_stack([roles, np.full(len(roles), -math.inf)])


def rows_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with the conversation they belong to and what orders them."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("given"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a null conversation falls apart by row
    group = F.when(F.col("conv").isNull(), F.concat(F.lit("n"), F.uuid())).otherwise(F.concat(F.lit("c"), F.col("conv").cast("string")))
    return rows.withColumns({"group": group, "rh": F.xxhash64("text"), "seq": F.monotonically_increasing_id()})


def parsed(rows: DataFrame) -> DataFrame:
    """One row for each part, numbered from 0, with its marker and features; text is the body. only: its row has no other part; noun: the marker may be an ordinary label."""
    keep = [c for c in rows.columns if c != "text"]
    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", part int, only boolean, noun boolean, marker string, text string, seen array<int>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            found = [parts(t) for t in batch.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = [p for x in found for p in x]
            cols = [batch.column(c).take(at) for c in keep] + [[k for x in found for k in range(len(x))], [len(x) == 1 for x in found for _ in x], [is_plain(m) and speaker(m) not in CLEAR for m, _ in flat], [m for m, _ in flat], [CLOSED.sub("", t) for _, t in flat], [features(m, t) for m, t in flat]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.select(*keep, "text").mapInArrow(run, ddl)


def placed(turns: DataFrame, per_block: int) -> DataFrame:
    """Adds place (from 0 in the conversation), block and obs, without bringing a conversation, or the rows of one turn number, into
    one task: cells of a turn number and a part of the hashes are counted first, within ranges of turn numbers."""
    number = F.col("turn").try_cast("bigint") if dict(turns.dtypes)["turn"] == "string" else F.col("turn").cast("bigint")
    slot = F.when(number.isNotNull() | F.col("turn").isNull(), F.shiftrightunsigned("rh", 56)).otherwise(F.lit(0).cast("bigint"))
    cut = turns.withColumns({"t": F.coalesce(number, F.lit(-(2**62))), "slot": slot}).withColumn("range", F.floor(F.col("t") / per_block))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = written(cut.groupBy("group", "range", "t", "slot").agg(F.count(F.lit(1)).alias("n")))
    ranges = cells.groupBy("group", "range").agg(F.sum("n").alias("n")).withColumn("range_before", before(Window.partitionBy("group").orderBy("range"))).drop("n")
    cells = cells.withColumn("cell_before", before(Window.partitionBy("group", "range").orderBy("t", "slot"))).drop("n")
    inner = F.row_number().over(Window.partitionBy("group", "range", "t", "slot").orderBy(F.col("turn").asc_nulls_first(), "rh", F.col("given").asc_nulls_first(), "seq", "part")) - 1
    out = cut.withColumn("inner", inner).join(cells, ["group", "range", "t", "slot"]).join(ranges, ["group", "range"])
    place = F.col("range_before") + F.col("cell_before") + F.col("inner")
    out = out.withColumn("place", place.cast("bigint")).withColumn("block", F.floor(F.col("place") / per_block))
    obs = F.concat("seen", F.array((F.col("place") == 0).cast("int")))
    return out.withColumn("obs", obs).drop("t", "slot", "range", "inner", "cell_before", "range_before", "rh", "seen")


def train(turns: DataFrame, smooth: float = 0.5, trust: float = 20.0, pooled: float = 5.0) -> Model:
    """Counts over all labelled rows of one part; the tables have a fixed size. trust: counts by which a marker names its own role;
    pooled: counts that each role takes over from all roles together, so that a role seldom met looks like any other."""
    r, s = len(ROLES), smooth
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.lower("given")).cast("int") - 1
    known = written(turns.where("only").select("group", "place", "obs", role.alias("role")).where("role >= 0"))
    start, step = np.full(r, s), np.full((r, r), s)
    emit = [np.full((r, n), s) for n in SIZES]
    emit[0][:, 1:] += trust * np.eye(r)
    for x in known.where("place = 0").groupBy("role").count().collect():
        start[x.role] += x["count"]
    nxt = known.select("group", (F.col("place") - 1).alias("place"), F.col("role").alias("next"))
    for x in known.join(nxt, ["group", "place"]).groupBy("role", "next").count().collect():
        step[x.role, x.next] += x["count"]
    for x in known.select("role", F.posexplode("obs").alias("k", "v")).groupBy("role", "k", "v").count().collect():
        emit[x.k][x.role, x.v] += x["count"]
    drop(known)
    log = lambda a: np.log(a / a.sum(-1, keepdims=True))
    emit = [e if k == 0 else e + pooled * e.sum(0) / e.sum() for k, e in enumerate(emit)]
    # whether there is a marker says nothing of the role; whom it names does
    return Model(log(start), log(step), [np.column_stack([np.zeros(r), log(emit[0][:, 1:])]), *map(log, emit[1:])])


def best_path(steps: np.ndarray, scores: np.ndarray, before: int, last: int | None = None) -> list[int]:
    """Viterbi from the state before the first turn. With last, the path has to end there."""
    v, back = steps[before] + scores[0], []
    for s in scores[1:]:
        x = v[:, None] + steps
        back.append(x.argmax(0))
        v = x.max(0) + s
    at = int(v.argmax()) if last is None else last
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return path[::-1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best scores through two blocks."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def span_matrix(steps: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Best score of a block's turns, from the role before it to the role at its end."""
    m = steps + scores[0][None, :]
    for s in scores[1:]:
        m = (m[:, :, None] + steps[None, :, :]).max(1) + s[None, :]
    return m


MATRIX, ENDS, PATH = "`group` string, block bigint, m array<double>", "`group` string, block bigint, before int, after int", "`group` string, place bigint, role string"


def recovered(turns: DataFrame, model: Model, per_block: int) -> DataFrame:
    """(group, place, role) of turns with group, place, block and obs, by Viterbi over whole conversations."""
    size, steps = len(ROLES) + 1, model.steps
    matrix_schema, ends_schema, path_schema = arrow_schema(MATRIX), arrow_schema(ENDS), arrow_schema(PATH)
    blocks = written(turns.groupBy("group", "block").agg(F.array_sort(F.collect_list(F.struct("place", "obs"))).alias("turns")))

    def matrices(batch, ms):
        return pa.RecordBatch.from_arrays([batch.column("group"), batch.column("block"), pa.array([m.ravel().tolist() for m in ms], pa.list_(pa.float64()))], schema=matrix_schema)

    def of(parts) -> list[np.ndarray]:
        return [np.array(p["m"]).reshape(size, size) for p in parts]

    def weigh(batches):
        for batch in batches:
            yield matrices(batch, [span_matrix(steps, model.scores(np.array([t["obs"] for t in x]))) for x in batch.column("turns").to_pylist()])

    def fold(batches):
        for batch in batches:
            yield matrices(batch, [reduce(product, of(parts)) for parts in batch.column("parts").to_pylist()])

    def grouped(level: DataFrame) -> DataFrame:
        return level.groupBy("group", F.floor(F.col("block") / per_block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("parts"))

    levels = [written(blocks.mapInArrow(weigh, MATRIX))]
    while levels[-1].where("block > 0").limit(1).count():
        levels.append(written(grouped(levels[-1]).mapInArrow(fold, MATRIX)))

    def choose(batches):
        """One level down: the states before and at the end of each part, given those of the whole."""
        for batch in batches:
            out = []
            for group, parts, before, after in zip(*(batch.column(c).to_pylist() for c in ("group", "parts", "before", "after")), strict=True):
                v, back = np.where(np.arange(size) == before, 0.0, -math.inf), []
                for m in of(parts):
                    x = v[:, None] + m
                    back.append(x.argmax(0))
                    v = x.max(0)
                at, ends = int(v.argmax()) if after is None else after, []
                for b in reversed(back):
                    ends.append(at)
                    at = int(b[at])
                ends = ends[::-1]
                out += [(group, p["block"], x, e) for p, x, e in zip(parts, [before, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ends_schema, strict=True)], schema=ends_schema)

    state = levels[-1].select("group", "block", F.lit(size - 1).alias("before"), F.lit(None).cast("int").alias("after"))
    for level in reversed(levels[:-1]):
        state = written(grouped(level).join(state, ["group", "block"]).select("group", "parts", "before", "after").mapInArrow(choose, ENDS))

    def walk(batches):
        for batch in batches:
            out = []
            for group, rows, before, after in zip(*(batch.column(c).to_pylist() for c in ("group", "turns", "before", "after")), strict=True):
                path = best_path(steps, model.scores(np.array([t["obs"] for t in rows])), before, after)
                out += [(group, t["place"], ROLES[k]) for t, k in zip(rows, path, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), path_schema, strict=True)], schema=path_schema)

    return blocks.join(state, ["group", "block"]).select("group", "turns", "before", "after").mapInArrow(walk, PATH)


def chat_turns(df: DataFrame, *, folds: int = 5, per_block: int = 512, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, turn_col, part, held_out, given_role, role, rendered): one row for each turn found, part numbering those of one row from 0.

    Conversations with crc32(conv) mod folds = 0 are held out: given_role isn't learned from there. Where the role is
    the same as in the turn before, rendered goes on with the turn instead of opening a new one."""
    rows = written(rows_of(df, conv_col, turn_col, role_col, text_col))
    turns = written(placed(parsed(rows), per_block).withColumn("held_out", F.coalesce(F.crc32(F.col("conv").cast("string").cast("binary")) % folds == 0, F.lit(False))))
    drop(rows)
    model = train(turns.where("not held_out"))
    roles = written(recovered(turns.select("group", "place", "block", "obs"), model, per_block))
    near = lambda by, name: roles.select("group", (F.col("place") + by).alias("place"), F.col("role").alias(name))
    out = turns.join(roles, ["group", "place"]).join(near(1, "before"), ["group", "place"], "left").join(near(-1, "after"), ["group", "place"], "left")
    marked = F.col("obs")[0]
    lone = turns.groupBy("group").agg(F.count_if(marked > 0).alias("marks"), F.max("noun").alias("noun")).where("noun and marks < 2").select("group", F.lit(True).alias("lone"))
    out = out.join(lone, "group", "left")
    goes_on, ends = F.col("before").eqNullSafe(F.col("role")), ~F.col("after").eqNullSafe(F.col("role"))
    other = (marked > 0) & (F.get(F.array(*map(F.lit, ROLES)), marked - 1) != F.col("role"))
    stays = (goes_on & (F.col("part") > 0)) | other | (F.col("noun") & F.coalesce("lone", F.lit(False)))
    text = F.regexp_replace(F.when(stays, F.concat("marker", "text")).otherwise(F.col("text")), r"^\s+|\s+$", "")
    rendered = F.concat(F.when(goes_on, "").otherwise(F.concat(F.lit("<|"), "role", F.lit("|>\n"))), text, F.when(ends, "\n<|end|>").otherwise(""))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "part", "held_out", F.col("given").alias("given_role"), F.col("role").alias("role"), rendered.alias("rendered"))
