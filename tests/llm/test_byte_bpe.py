import random
import struct

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Regex, Tokenizer, pre_tokenizers

from ledgerlight.llm import byte_bpe as b
from tests.llm.test_tokens import ODD, texts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SPACES = [" ", " ", " ", " ", "　", "​", "\x1f", "\r\n", "'ll", "'LL", "ſ", "½", "٣"]


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=b.ranks_of(PATH), special_tokens={})


def ids(x):
    return list(struct.unpack(f"<{len(x) // 4}I", x))


def test_merges_are_those_of_the_library(theirs):
    bpe = b.ByteBpe(b.specification(PATH, PATTERN))
    rng = random.Random(4)
    some = texts(1500, 3, 30) + ["".join(rng.choice(ODD + SPACES) for _ in range(rng.randrange(25))) for _ in range(1500)] + ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(rng.randrange(20))) for _ in range(500)]
    assert list(map(ids, bpe.ids(some))) == [theirs.encode_ordinary(s) for s in some]
    for s, x in zip(some, bpe.ids(some), strict=True):
        assert bpe.bytes(x) == s.encode() and "".join(bpe.texts(x)) == s


def test_white_space_ends_parts_as_it_ends_pieces():
    space, split = pre_tokenizers.Split(Regex(r"\s"), "removed"), []
    for i in [*range(0xD800), *range(0xE000, 0x110000)]:
        if not space.pre_tokenize_str(chr(i)):
            split.append(chr(i))
    assert "".join(split) == "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if b.PARTS.fullmatch(c) and not b.PARTS.fullmatch(" " + c + "x") and b.re.fullmatch(f"[{b.SPACE}]", c))


def test_offsets_are_the_librarys():
    bpe, whole = b.ByteBpe(b.specification(PATH, PATTERN)), Tokenizer.from_str(b.specification(PATH, PATTERN))
    for s in [*texts(300, 5), "🙂🙂 日本 \U0001f9ff", ""]:
        (x,) = bpe.ids([s])
        starts, ends, first, last = bpe.offsets(x, s.encode())
        assert list(zip(first.tolist(), last.tolist())) == whole.encode(s).offsets
        assert b"".join(s.encode()[i:j] for i, j in zip(starts, ends)) == s.encode()


def test_split_characters(spark):
    bpe = b.ByteBpe(b.specification(PATH, PATTERN))
    (x,) = bpe.ids(["a🧿b"])
    per = bpe.texts(x)
    assert len(per) > 3 and "".join(per) == "a🧿b" and "" in per
    df = spark.createDataFrame([(1, x[:8], "q"), (2, x, "q"), (3, b"", "q"), (4, None, "q")], "doc_id int, ids binary, bytes string")
    got = {r.doc_id: (None if r.bytes is None else bytes(r.bytes), r.decoded, r.pieces) for r in b.decode(df, PATH, PATTERN, pieces=True).collect()}
    assert got[2] == ("a🧿b".encode(), "a🧿b", per) and got[3] == (b"", "", []) and got[4] == (None, None, None)
    assert got[1][0] == bpe.bytes(x[:8]) and got[1][1] == "a�" and "".join(got[1][2]) == "a�"


def test_rows(spark, theirs):
    some = [*texts(200, 6, 40), "", None, "z" * 200_000, "wörd " * 60_000, "same", "same"]
    rows = [(i, t, "x", 1) for i, t in enumerate(some)] + [(None, "no id", None, None), (3, some[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    got = b.encode(df, PATH, PATTERN, offsets=True, decoded=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens, ids(r.ids), bytes(r.decoded)) for r in got) == sorted((str(i), len(x := theirs.encode_ordinary(t or "")), x, (t or "").encode()) for i, t, *_ in rows)
    assert all(len(r.char_ends) == r.n_tokens and (not r.n_tokens or r.byte_ends[-1] == len(r.decoded)) for r in got)
    assert b.encode(df.limit(0), PATH, PATTERN).count() == 0


def test_vocabularies_of_other_languages(theirs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=b.ranks_of(path), special_tokens={})
    bpe = b.ByteBpe(b.specification(path, PATTERN))
    some = texts(500, 7, 30)
    assert list(map(ids, bpe.ids(some))) == [enc.encode_ordinary(s) for s in some]
