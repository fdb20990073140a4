"""BPE encoding and decoding over the distinct words of the corpus.

1. Each task goes through its rows in blocks of about ``block_chars`` characters, splits texts into words, and gives
   each distinct word of a block once: (word, block).
2. These rows are shuffled by word and sorted, so that all rows of a word stand together: it is encoded once, and its ids
   go back to every block that holds it.
3. Texts meet their block's words in a second shuffle by block. In its partition a block's words come first and
   its texts after them, and ids take the places of the words they belong to. Both move compressed.

Nothing is collected or broadcast but the vocabulary, and a task holds the words of one block at a time, however large the
corpus is. A word has no more rows than there are blocks, so no key is hot. Blocks follow the order in which the input is
read; a word that is missing, because rows came in another order the second time, is encoded where it stands, so results never depend on it.
Decoding joins ids with the id-to-piece table, which has a row for each entry of the vocabulary and is broadcast.

Nulls: a null text is empty: no ids, an empty decoded text. Empty tables give empty results; rows repeat as they
do in the input; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlight.llm.common import arrow_schema, map_batches, trim
from ledgerlight.llm.pretokens import encoder, splitter

#: Texts and replies that are handled at a time.
TEXTS, REPLIES = 500, 200_000
REPLY = "block bigint, words binary, ids binary"


def packed(parts: list) -> bytes:
    """Texts, or byte strings, as one compressed value: these are most of what the shuffles move."""
    whole = ("" if not parts or isinstance(parts[0], str) else b"").join(parts)
    lengths = np.fromiter(map(len, parts), "<u4", len(parts)).tobytes()
    return zstandard.compress(len(parts).to_bytes(4, "little") + lengths + (whole.encode("utf-8", "surrogatepass") if isinstance(whole, str) else whole), 3)


def unpacked(value: bytes, as_text: bool) -> list:
    raw = zstandard.decompress(value)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64).tolist()
    whole = raw[4 + 4 * n :]
    if as_text:
        whole = whole.decode("utf-8", "surrogatepass")
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def in_blocks(batches: Iterator[pa.RecordBatch], text_at: int, block_chars: int) -> Iterator[tuple[int, pa.RecordBatch, list]]:
    """(block, rows, texts) of a task: rows in the order they come, a new block after so many characters."""
    first, chars = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            rows = batch.slice(at, TEXTS)
            texts = rows.column(text_at).to_pylist()
            ends = chars + np.cumsum([len(t or "") for t in texts])
            block = np.concatenate([[chars], ends[:-1]]) // block_chars
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                yield first + int(block[a]), rows.slice(a, b - a), texts[a:b]
            chars = int(ends[-1])


def words_of_blocks(docs: DataFrame, path: str, block_chars: int) -> DataFrame:
    """(word, block): the distinct words of each block."""
    ddl = "word string, block bigint"
    schema = arrow_schema(ddl)

    def run(batches):
        cut = splitter(path)
        block, parts, words = -1, set(), set()

        def rows():
            words.update(chain.from_iterable(cut.split(p) for p in parts if isinstance(p, str)))
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.full(len(words), block, np.int64))], schema=schema)
            parts.clear()
            words.clear()
            return out

        for b, _, texts in in_blocks(batches, 0, block_chars):
            if b != block and parts:
                yield rows()
            block = b
            for text in texts:
                if text:
                    parts.update(cut.all_parts(text))
        if parts:
            yield rows()
        del parts, words
        trim()

    return docs.select("text").mapInArrow(run, ddl)


def encoded_words(pairs: DataFrame, path: str, width: str) -> DataFrame:
    """Each distinct word is encoded here, once, and given to all blocks that hold it: (block, words, ids), some words packed in each row."""
    schema = arrow_schema(REPLY)

    def run(batches):
        of_part = encoder(path).of_part
        last, ids = None, b""
        words, found, n = defaultdict(list), defaultdict(list), 0

        def rows():
            cols = [list(words.keys()), list(map(packed, words.values())), list(map(packed, found.values()))]
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            words.clear()
            found.clear()
            return out

        for batch in batches:
            for word, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word != last:
                    last, ids = word, np.frombuffer(of_part(word), "<u4").astype(width).tobytes()
                words[block].append(word)
                found[block].append(ids)
            n += batch.num_rows
            if n >= REPLIES:
                yield rows()
                n = 0
        if words:
            yield rows()
        trim()

    return pairs.repartition("word").sortWithinPartitions("word").mapInArrow(run, REPLY)


def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 16_000_000, digests: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids): ids of each row's whole text, as little-endian unsigned 32-bit integers in one binary value.

    With ``digests``, (id_col, n_tokens, ids_sha256, decoded_sha256) instead: the round trip, without moving ids and texts."""
    width = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 65_536 else "<u4"
    size = np.dtype(width).itemsize
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    replies = encoded_words(words_of_blocks(docs, path, block_chars), path, width)
    ddl = f"block bigint, kind int, id array<{kind}>, text binary"
    schema = arrow_schema(ddl)

    def numbered(batches):
        for block, rows, texts in in_blocks(batches, 1, block_chars):
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int32()), ids.cast(schema.field("id").type), pa.array([packed([t or "" for t in texts])], pa.binary())], schema=schema)

    texts = docs.mapInArrow(numbered, ddl)
    both = texts.unionByName(replies.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    met = both.repartition("block").sortWithinPartitions("block", "kind")
    pieces = pieces_by_id(df.sparkSession, path) if digests else None
    out_ddl = f"`{id_col}` {kind}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary")
    out_schema = arrow_schema(out_ddl)

    def placed(batches):
        cut, of_part = splitter(path), encoder(path).of_part
        known: dict[str, bytes] = {}
        parts: dict[str | int, tuple[bytes, bytes]] = {}
        block = None

        def of_word(word) -> bytes:
            ids = known.get(word)
            return np.frombuffer(of_part(word), "<u4").astype(width).tobytes() if ids is None else ids

        def learn(part) -> None:
            ids = b"".join(map(of_word, cut.split(part))) if isinstance(part, str) else part.to_bytes(size, "little")
            parts[part] = ids, decoded(np.frombuffer(ids, width), pieces.value) if digests else b""

        def answer(ids: pa.Array, texts: list) -> pa.RecordBatch:
            found, back = [], []
            for text in texts:
                own = cut.all_parts(text)
                for p in set(own).difference(parts):
                    learn(p)
                own = [parts[p] for p in own]
                found.append(np.frombuffer(b"".join([x for x, _ in own]), width).astype("<u4").tobytes())
                if digests:
                    back.append(hashlib.sha256(b" ".join([x for _, x in own if x])).hexdigest())
            cols = [ids, pa.array([len(x) // 4 for x in found], pa.int64())]
            cols += [pa.array([hashlib.sha256(x).hexdigest() for x in found]), pa.array(back, pa.string())] if digests else [pa.array(found, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, schema=out_schema)

        for batch in batches:
            for k, (b, kind_of) in enumerate(zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if b != block:
                    block = b
                    known.clear()
                    parts.clear()
                if kind_of == 0:
                    known.update(zip(unpacked(batch.column("words")[k].as_py(), True), unpacked(batch.column("ids")[k].as_py(), False), strict=True))
                else:
                    yield answer(batch.column("id")[k].values, unpacked(batch.column("text")[k].as_py(), True))
        del known, parts
        trim()

    return met.mapInArrow(placed, out_ddl)


def piece_table(spark, path: str) -> DataFrame:
    """(id, piece): every entry of the vocabulary."""
    return spark.createDataFrame(sorted((i, s) for s, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items()), "id int, piece string")


def pieces_by_id(spark, path: str):
    """The id-to-piece table for a map-side join, broadcast: as long as the vocabulary."""
    if Tokenizer.from_file(path).decoder is not None:
        raise ValueError("tokenizers with a decoder of their own aren't supported")
    rows = {r.id: r.piece.encode() for r in piece_table(spark, path).collect()}
    return spark.sparkContext.broadcast([rows.get(i) for i in range(max(rows) + 1)])


def decoded(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    """The text of ids in UTF-8, as the library joins pieces for a tokenizer without decoder, special tokens kept."""
    return b" ".join(map(pieces.__getitem__, ids.tolist()))


def decode(df: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, decoded): texts of ``ids_col``, by a map-side join with the id-to-piece table. Null ids give null."""
    pieces = pieces_by_id(df.sparkSession, path)
    cols = [id_col, *keep]
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols) + ", decoded string"

    def make():
        table = pieces.value

        def of(batch):
            return {c: batch.column(c) for c in cols} | {"decoded": [None if x is None else decoded(np.frombuffer(x, "<u4"), table).decode() for x in batch.column(ids_col).to_pylist()]}

        return of

    return map_batches(df.select(*dict.fromkeys((*cols, ids_col))), make, ddl)
