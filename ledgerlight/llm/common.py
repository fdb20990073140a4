"""What the operators share: hashing of words and batches of Arrow; intermediate tables and connected components are those of the library."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlight.session import shared_folder as shared_dir
from ledgerlight.tables import components, delete, drop, free, n_written, taken, written

#: Words: runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A-Z only; other letters keep their case.
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, which none of df's has, in any case of letters."""
    taken_already, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken_already:
            name = f"_{name}"
        taken_already.add(name.lower())
        out.append(name)
    return out


def trim() -> None:
    """Gives a worker's free memory back: idle workers of other stages stay beside those that run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str) -> DataFrame:
    """mapInArrow; ``make()`` runs once a task and returns the function of a batch, which gives columns by name."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            if batch.num_rows:
                cols = of(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in schema], schema=schema)
                del cols
        del of
        trim()

    return df.mapInArrow(run, ddl)


class Recent(dict):
    """make(key), remembered: at most twice ``most`` entries, those not met again go first."""

    def __init__(self, make: Callable, most: int = 250_000) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.add(key, found)
        return found

    def add(self, key, found) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found


def word_hashes(text: str | None, *, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words of a text; with ``lower``, A-Z count as a-z and other letters keep their case.

    bytes.lower() and bytes.split() know ASCII only, which is just what words are made by."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, (raw.lower() if lower else raw).split())), ">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; where there are fewer, one for the whole sequence; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    # words' hashes are random, so an odd multiple of each keeps sums apart
    return mixed(sum(hashes[i : n - k + 1 + i] * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1) for i in range(k)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


__all__ = ["LOWER", "Recent", "WORD", "arrow_schema", "components", "delete", "drop", "free", "fresh", "map_batches", "mixed", "n_written", "shared_dir", "shingle_hashes", "signed", "taken", "trim", "word_hashes", "words_of", "written"]
