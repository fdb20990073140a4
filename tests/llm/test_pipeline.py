import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as c
from ledgerlight.llm import packing
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_jaccard_join import corpus
from tests.llm.test_quality_rules import brute as measures
from tests.llm.test_secret_scan import brute as secrets


def test_each_stage_does_what_it_says(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    rows = [(i, text(rng.randrange(60, 200)), "en", f"s{i % 3}") for i in range(150)]
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(10)]  # exact copies
    rows += [(300 + i, rows[20 + i][1] + " more", "en", "s1") for i in range(10)]  # near-copies
    rows += [(400 + i, f"{text(60)} {passage} {text(60)}", "en", "s2") for i in range(6)]
    rows += [(500 + i, f"{text(80)} token = \"{rng.randbytes(20).hex()}\" {text(20)}", "en", "s0") for i in range(10)]
    rows += [(600, None, "en", "s1"), (601, "too short", None, None), (602, text(80).replace(" ", "### "), "en", "s0"), (None, text(90), None, "s1")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == df.columns
        kept.append(docs.collect())
    quality, near, cut, clean, packed = kept
    ids = lambda found: {r.doc_id for r in found}
    assert ids(quality) == {d for d, *_ in rows} - {600, 601, 602} and all(measures(r.text)[0] >= 50 for r in quality)
    groups = components([(r.doc_id, r.text) for r in quality])
    assert ids(near) == {r.doc_id for r in quality if any(d == low == str(r.doc_id) for d, _, low in groups)}
    assert sum(passage in r.text for r in near) == 6 and sum(passage in r.text for r in cut) == 1 and ids(cut) == ids(near)
    assert {r.doc_id: r.text for r in cut if r.doc_id != 400 and not 400 <= (r.doc_id or 0) < 410} == {r.doc_id: r.text for r in near if not 400 <= (r.doc_id or 0) < 410}
    assert sum(len(secrets(r.text)) > 0 for r in cut) == 10 and not any(secrets(r.text) for r in clean) and all(r.n_chars == len(r.text) for r in clean)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean}
    assert {r.doc_id: r.length for r in packed} == lengths
    assert len({r.sequence_id for r in packed}) <= len(packing.best_fit(list(range(len(lengths))), list(lengths.values()), 4096)) + 1
    assert c.run(spark, str(tmp_path)).count() == len(packed)


def test_near_copies_share_four_fifths_of_their_five_word_shingles(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    base = text(100)
    rows = [(1, base), (2, f"{base} {text(18)}"), (3, f"{base} {text(30)}"), (4, text(100)), *((10 + d, t) for d, t in corpus(7) if d is not None)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(r.doc_id for r in c.near_copies(spark, df, str(tmp_path)).collect())
    groups = {(d, low) for d, _, low in components(rows, num=80, k=5)}
    assert [d for d in got if d < 10] == [1, 3, 4]
    assert set(got) == {d for d, _ in rows} - {int(d) for d, low in groups if d != low and (d, d) not in groups}


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_stages_decide_by_id_and_text(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    a, b, good, shared = text(90), text(90), text(90), text(90)
    rows = [(1, a), (None, a), (None, b), (2, good), (2, "too short"), (None, "also short"), (3, shared), (3, shared), (4, text(90))]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {(r.doc_id, r.text) for r in c.quality(spark, df, str(tmp_path)).collect()}
    assert kept == {(d, t) for d, t in rows if "short" not in t}
    near = sorted((str(r.doc_id), r.text) for r in c.near_copies(spark, df, str(tmp_path)).collect())
    assert near == sorted((str(d), t) for d, t in [(1, a), (None, b), (2, good), (2, "too short"), (None, "also short"), (3, shared), rows[-1]])


def test_columns_of_any_name_pass_through(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(80)} {passage}") for i in range(4)] + [(9, "too short"), (10, rows_text := text(90)), (11, rows_text)]
    names = ("_id", "_th", "_ranges", "key", "id", "th", "spans", "row", "text_2", "_ID2")
    df = spark.createDataFrame([(d, t, "en", "s", len(t), *(f"{n}{d}" for n in names)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))
    docs = df
    for k, (_, stage) in enumerate(c.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == df.columns
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(kept) == {0, 1, 2, 3, 10} and all(kept[d][n] == f"{n}{d}" for d in kept for n in names)
    assert sum(passage in r.text for r in kept.values()) == 1
