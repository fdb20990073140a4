"""The registered queries on the smallest tables, against libraries, brute force or SQL."""

import hashlib
import os
import struct
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

from ledgerlight.llm import oracles, queries
from tests.llm.test_secret_scan import brute as secrets
from tests.test_queries import TABLES, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(oracles.SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_tokens(spark, docs):
    word, byte = Tokenizer.from_file(queries.WORD_BPE), Tokenizer.from_file(queries.BYTE_BPE)
    ids = {d: word.encode(t or "", add_special_tokens=False).ids for d, t in docs.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, SF).collect()}
    assert got == {d: (len(x), sha(struct.pack(f"<{len(x)}I", *x)), sha(word.decode(x, skip_special_tokens=False).encode())) for d, x in ids.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op10_token_counts(spark, SF).collect()}
    n = {d: len(byte.encode(t or "", add_special_tokens=False).ids) for d, t in docs.items()}
    assert got == {d: (len((t or "").encode()), n[d], n[d] > 1024) for d, t in docs.items()}
    packed = queries.op5_packing(spark, SF).collect()
    for r in packed:
        x = [*ids[r.doc_id], 1][r.start : r.start + r.length]
        assert len(x) == r.length and zlib.crc32(struct.pack(f"<{len(x)}I", *x)) == r.ids_crc32
    assert sum(r.length for r in packed) == sum(len(x) + 1 for x in ids.values())


def test_secrets(spark, docs):
    for r in queries.op6_secret_scan(spark, SF).collect():
        spans = secrets(docs[r.doc_id])
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == q for _, k, _ in spans) for q in range(3))


def test_all_answer_every_row(spark, docs):
    found = queries.queries()
    for name in ("op1_chat_format", "op3_toxicity", "op8_passage_dedup"):
        got = found[name](spark, SF)
        table = "conversations" if name.startswith("op1_") else "documents"
        assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    scores = found["op3_toxicity"](spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scores)
