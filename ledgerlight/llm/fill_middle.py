"""Fill-in-middle: texts are cut in three and the middle is moved to the end.

A text is counted once, in UTF-8. While units are counted (code points, or the matches of a pattern), a checkpoint is
kept every ``every`` units: units, bytes and code points so far. A cut after u units is found by binary search for the
last checkpoint not beyond u, and a scan of at most ``every`` units from there, so a text is neither decoded whole nor indexed
by unit, and any number of cuts costs one count.

Which row is cut how follows from a hash of its id and ``seed`` only, so it doesn't depend on order or partitioning.

Nulls: a null text is empty, and empty texts are plain. A null id hashes as an empty one. Rows are answered one by one:
rows that share an id are cut at the same hashes, repeated rows repeat, an empty table gives an empty one, and
other columns are ignored, whatever their names. A text that holds one of the marks is left plain, whole, so the marks of an
output are always those put there, and the text can be rebuilt from output and form.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import arrow_schema, trim

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes counted at a time, and bytes of texts that leave a task at a time.
CHUNK, SENT = 1 << 16, 8_000_000


class Checkpoints:
    """Where every ``every``-th unit of a text ends, in bytes and in code points.

    Units are code points, or matches of ``pattern`` from left to right; what stands between two matches goes with the
    later one, and what follows the last belongs to no unit."""

    def __init__(self, raw: bytes, every: int = 1024, pattern: regex.Pattern | None = None) -> None:
        self.raw, self.every, self.pattern = raw, every, pattern
        self.units, self.bytes, self.points = [0], [0], [0]
        if pattern is None:
            self._count_points()
        else:
            self._count_matches()

    def _count_points(self) -> None:
        n, every, raw = 0, self.every, np.frombuffer(self.raw, np.uint8)
        for at in range(0, len(raw), CHUNK):
            # a code point begins at each byte that doesn't continue one; the first here is number n
            begins = np.flatnonzero((raw[at : at + CHUNK] & 0xC0) != 0x80)
            for u in range(max(n + -n % every, every), n + len(begins), every):
                self._add(u, at + int(begins[u - n]), u)
            n += len(begins)
        self.n = n

    def _count_matches(self) -> None:
        self.text = self.raw.decode("utf-8", "surrogatepass")
        n = 0
        for n, m in enumerate(self.pattern.finditer(self.text), 1):
            if n % self.every == 0:
                self._add(n, self.bytes[-1] + len(self.text[self.points[-1] : m.end()].encode("utf-8", "surrogatepass")), m.end())
        self.n = n

    def _add(self, units: int, at_byte: int, at_point: int) -> None:
        self.units.append(units)
        self.bytes.append(at_byte)
        self.points.append(at_point)

    def cut(self, u: int) -> tuple[int, int]:
        """Bytes and code points of the first u units."""
        k = bisect_right(self.units, u) - 1
        more, at_byte, at_point = u - self.units[k], self.bytes[k], self.points[k]
        if not more:
            return at_byte, at_point
        if self.pattern is None:
            ahead = np.frombuffer(self.raw, np.uint8, min(len(self.raw) - at_byte, 4 * (more + 1)), at_byte)
            begins = np.flatnonzero((ahead & 0xC0) != 0x80)
            return at_byte + (int(begins[more]) if more < len(begins) else len(ahead)), at_point + more
        end = next(islice(self.pattern.finditer(self.text, at_point), more - 1, None)).end()
        return at_byte + len(self.text[at_point:end].encode("utf-8", "surrogatepass")), end


def hashes(seed: int, doc_id) -> list[int]:
    """h1 to h4: the first four groups of eight hexadecimal digits of the hash of an id."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4)]


@lru_cache(4)
def compiled(unit: str | None) -> regex.Pattern | None:
    return regex.compile(unit) if unit else None


def transformed(raw: bytes, h: list[int], *, every: int, unit: str | None, cut_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and the output of one text."""
    index = Checkpoints(raw, every, compiled(unit))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not raw or h[2] % 100 >= cut_percent or any(m in raw for m in marks):
        return index.n, "plain", None, None, raw
    (a, a_points), (b, b_points) = map(index.cut, sorted(x % (index.n + 1) for x in h[:2]))
    p, s, m = marks
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    return index.n, form, a_points, b_points - a_points, b"".join([s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle])


def fill_in_middle(df: DataFrame, *, seed: int = 1, cut_percent: int = 90, spm_percent: int = 20, every: int = 1024, unit: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output), one row for each row of df.

    n counts units: code points, or matches of the pattern ``unit``. form is plain, psm (prefix, suffix, middle) or spm;
    prefix_chars and middle_chars are code points, null where plain. Of the texts, cut_percent in 100 are cut, and of those
    spm_percent in 100 have the suffix first."""
    ddl = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    schema = arrow_schema(ddl)

    def run(batches):
        def batch_of(ids: list, rows: list) -> pa.RecordBatch:
            cols = [pa.array(ids, schema.field(0).type), *(pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True))[:4], list(schema)[1:5], strict=True))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([r[4] for r in rows], pa.binary()).cast(schema.field("output").type)], schema=schema)

        for batch in batches:
            ids, rows, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids.append(doc_id)
                rows.append(transformed(raw, hashes(seed, doc_id), every=every, unit=unit, cut_percent=cut_percent, spm_percent=spm_percent))
                size += len(raw)
                if size >= SENT:
                    yield batch_of(ids, rows)
                    ids, rows, size = [], [], 0
            if ids:
                yield batch_of(ids, rows)
        trim()

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ddl)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: what follows each mark, in the order prefix, middle, suffix."""
    psm = F.regexp_replace(output, f"(?s)^{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(found: DataFrame) -> DataFrame:
    """Hashes in place of texts: of the output, and of the text rebuilt from it."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.withColumns({"output_sha256": sha(F.col("output")), "restored_sha256": sha(restored(F.col("output"), F.col("form")))}).drop("output")
