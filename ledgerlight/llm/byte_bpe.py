"""Byte-level BPE by the tokenizers library over Arrow batches, and back.

The vocabulary comes as ranks of byte strings. The library wants characters, so each byte is written as the character
that stands for it (pretokens.byte_alphabet), and merges, so each token is split into the two parts whose merge makes it:
those that merging by lower ranks alone ends with. The tokenizer made of these is built once and broadcast; its size is
that of the vocabulary.

A task cuts texts into parts at white space, where the pattern always ends a piece, gives the library those parts of a
batch that it has not met lately, and sets their ids in their places. Decoding turns the alphabet round: a token is a run
of bytes, which may begin or end inside a character. ``offsets`` maps bytes to characters, so a token that holds a part of
a character has the whole character's place, and characters are only made of whole runs of bytes.

Nulls: a null text is empty: no ids, nothing decoded. Rows are answered one by one: repeated rows and ids repeat, an empty
table gives an empty one, texts of any length are whole, and other columns are ignored, whatever their names. An id that
the vocabulary lacks is an error; null ids decode to null.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from ledgerlight.llm.common import Recent, arrow_schema, trim
from ledgerlight.llm.pretokens import byte_alphabet

#: White space as in Unicode: what \s stands for in both libraries.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Splits at white space as PATTERN does: a blank goes with what follows it, other white space with the white space before it.
PARTS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Characters of texts, and ids, that are handled at a time.
CHARS, IDS = 2_000_000, 1_000_000


@lru_cache(2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the merge of a token joins."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= ranks[token]:
            raise ValueError(f"no merges of lower ranks make {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def spelled(path: str) -> dict[bytes, str]:
    """Tokens in the alphabet of bytes."""
    letter = {b: c for c, b in byte_alphabet().items()}
    return {t: "".join(map(letter.__getitem__, t)) for t in ranks_of(path)}


@lru_cache(2)
def specification(path: str, pattern: str) -> str:
    """The tokenizer of the ranks at ``path``, pieces split by ``pattern``, as the library writes it."""
    ranks, text = ranks_of(path), spelled(path)
    merges = [tuple(map(text.__getitem__, halves(t, ranks))) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1]
    made = Tokenizer(models.BPE({text[t]: i for t, i in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


class ByteBpe:
    """Ids of texts and bytes of ids; parts met lately aren't encoded again."""

    def __init__(self, specification: str, most: int = 150_000) -> None:
        self.tokenizer = Tokenizer.from_str(specification)
        to_byte = byte_alphabet()
        vocab = self.tokenizer.get_vocab()
        self.pieces: list[bytes | None] = [None] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.pieces[i] = bytes(map(to_byte.__getitem__, s))
        self.lengths = np.array([len(p or b"") for p in self.pieces])
        self.known = Recent(self._one, most)

    def _one(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = list(map(PARTS.findall, texts))
        new = list(set().union(*parts).difference(self.known, self.known.old))
        found = dict(zip(new, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        for part, ids in found.items():
            self.known.add(part, ids)
        return [b"".join(map(self.known.__getitem__, own)) for own in parts]

    def bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each token in the bytes and in the characters of its text; characters that it holds in part count."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        # the character that each byte belongs to
        of_byte = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        return starts, ends, of_byte[starts] if len(ends) else starts, of_byte[ends - 1] + 1 if len(ends) else ends

    def texts(self, ids: bytes) -> list[str]:
        """The text of each token: a character split over several belongs to the one that completes it; what is none becomes U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.pieces[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        if out:
            out[-1] += decoder.decode(b"", True)
        return out


@lru_cache(2)
def loaded(specification: str) -> ByteBpe:
    """Kept for the life of a Python worker."""
    return ByteBpe(specification)


def broadcast(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    return spark.sparkContext.broadcast(specification(path, pattern))


def _in_slices(df: DataFrame, shared: Broadcast, ddl: str, most: int, size: Callable, answer: Callable) -> DataFrame:
    """mapInArrow by slices of about ``most`` of what size(value) counts in column 1; answer(bpe, values) gives all columns but the first ones."""
    schema = arrow_schema(ddl)

    def run(batches):
        bpe = loaded(shared.value)
        for batch in batches:
            values, start, room = batch.column(batch.num_columns - 1).to_pylist(), 0, 0
            for k, v in enumerate(values, 1):
                room += size(v)
                if room >= most or k == len(values):
                    cols = [*batch.slice(start, k - start).columns[:-1], *answer(bpe, values[start:k])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                    start, room = k, 0
        trim()

    return df.mapInArrow(run, ddl)


def encode(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids): ids of each row's whole text, little-endian unsigned 32-bit integers in one binary value.

    With ``offsets`` also byte_starts, byte_ends, char_starts, char_ends, arrays as long as ids. With ``decoded`` also the
    bytes that the ids stand for (binary), made of the ids alone."""
    shared = broadcast(df.sparkSession, path, pattern)
    ddl = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids binary"
    ddl += "".join(f", {c} array<int>" for c in ("byte_starts", "byte_ends", "char_starts", "char_ends") if offsets) + ", decoded binary" * decoded

    def answer(bpe: ByteBpe, texts: list) -> list:
        texts = [t or "" for t in texts]
        ids = bpe.ids(texts)
        cols = [[len(x) // 4 for x in ids], ids]
        if offsets:
            cols += map(list, zip(*(bpe.offsets(x, t.encode()) for x, t in zip(ids, texts, strict=True)), strict=True))
        return [*cols, list(map(bpe.bytes, ids))] if decoded else cols

    return _in_slices(df.select(F.col(id_col), F.col(text_col)), shared, ddl, CHARS, lambda t: len(t or ""), answer)


def decode(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids", pieces: bool = False) -> DataFrame:
    """(id_col, bytes, decoded): what the ids of each row stand for, as bytes and as text; bytes that make no character become U+FFFD.

    With ``pieces`` also the text that each id adds (array): a split character comes with the id that completes it."""
    shared = broadcast(df.sparkSession, path, pattern)
    ddl = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, bytes binary, decoded string" + ", pieces array<string>" * pieces

    def answer(bpe: ByteBpe, ids: list) -> list:
        raw = [None if x is None else bpe.bytes(x) for x in ids]
        cols = [raw, [None if x is None else x.decode("utf-8", "replace") for x in raw]]
        return [*cols, [None if x is None else bpe.texts(x) for x in ids]] if pieces else cols

    return _in_slices(df.select(F.col(id_col), F.col(ids_col)), shared, ddl, 4 * IDS, lambda x: len(x or b""), answer)
