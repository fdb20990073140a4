import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlight.llm import bpe_words, packing, pretokens, token_counts
from tests.llm.test_tokens import texts

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, n_tokens string, word string, piece string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)


def test_encode_and_decode_like_the_library(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(texts(300, 5, 40))] + [(300, None), (301, ""), (302, " ".join(f"w{rng.randrange(9000)}" for _ in range(30_000))), (7, "again"), (7, "again"), (None, "no id")]
    theirs = Tokenizer.from_file(PATH)
    want = sorted(((d if d is not None else -1), (e := theirs.encode(t or "", add_special_tokens=False)).ids, theirs.decode(e.ids, skip_special_tokens=False)) for d, t in rows)
    for block_chars in (3000, 16_000_000):
        ids = bpe_words.encode(frame(spark, rows), PATH, block_chars=block_chars)
        got = bpe_words.decode(ids, PATH, keep=("n_tokens", "ids")).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, list(struct.unpack(f"<{r.n_tokens}I", r.ids)), r.decoded) for r in got) == want
    assert bpe_words.encode(frame(spark, []), PATH).count() == 0


def test_each_distinct_word_is_encoded_once_and_goes_to_its_blocks(spark):
    rows = [(i, t) for i, t in enumerate(texts(200, 6, 30))]
    docs = frame(spark, rows).select("text").coalesce(1)
    pairs = bpe_words.words_of_blocks(docs, PATH, 2000).cache()
    assert pairs.count() == pairs.distinct().count() and pairs.select("block").distinct().count() > 3
    back = {}
    for batch in bpe_words.encoded_words(pairs, PATH, "<u4").toArrow().to_batches():
        for i, block in enumerate(batch.column("block").to_pylist()):
            back |= {(block, w): x for w, x in zip(bpe_words.unpacked(batch.column("words")[i].as_py(), True), bpe_words.unpacked(batch.column("ids")[i].as_py(), False))}
    assert set(back) == {(r.block, r.word) for r in pairs.collect()}
    assert all(len({x for (_, w), x in back.items() if w == word}) == 1 for word in {w for _, w in back})


def test_rows_in_another_order_the_second_time_get_the_same_ids(spark):
    rows = [(i, t) for i, t in enumerate(texts(200, 8, 30))]
    theirs = Tokenizer.from_file(PATH)
    shuffled = frame(spark, rows).orderBy(F.rand())  # another order each time it is read
    got = {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in bpe_words.encode(shuffled, PATH, block_chars=2000).collect()}
    assert got == {d: theirs.encode(t, add_special_tokens=False).ids for d, t in rows}


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 3, 40, 90, 250, 700])))) for i in range(400)] + [(None, None), (1, "a"), (1, "a")]
    size = 256
    cut = packing.pieces_written(frame(spark, rows), PATH, size=size)
    got = packing.pack(cut, size=size, per_cell=60).collect()
    ids = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        x = [*ids.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(str(d), k, at, len(x[at : at + size]), zlib.crc32(struct.pack(f"<{len(x[at:at + size])}I", *x[at : at + size]))) for k, at in enumerate(range(0, len(x), size))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    lengths = [w[3] for w in want]
    assert len(bins) <= 1.01 * len(packing.best_fit(list(range(len(lengths))), lengths, size)) + 1
    assert packing.pack(packing.pieces_written(frame(spark, []), PATH)).count() == 0


def test_epochs_write_no_tables_of_their_own(spark, monkeypatch):
    rng = random.Random(5)
    cut = packing.pieces_written(frame(spark, [(i, "alpha " * rng.choice([3, 40, 90, 250])) for i in range(300)]), PATH, size=256)
    made, written = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, **how: made.append(df.columns) or written(df, **how))
    got = packing.pack(cut, size=256, epochs=3).collect()
    assert [c[0] for c in made] == ["cell", "sequence_id"]  # the cells' pieces, and their bins
    assert len(got) == cut.count() and len({(r.doc_id, r.piece) for r in got}) == len(got)


def test_evolution_beats_best_fit_where_that_is_not_the_best():
    for seed in range(4):
        rng, size = random.Random(seed), 1000
        lengths = []
        for _ in range(40):  # three that fill a bin
            a = rng.randrange(380, 490)
            b = rng.randrange(250, (size - a) // 2)
            lengths += [a, b, size - a - b]
        items = list(range(len(lengths)))
        rng.shuffle(lengths)
        first = packing.best_fit(items, lengths, size)
        best = None
        for epoch in range(3):
            best = packing.evolve(lengths, size, seed * 10 + epoch, best, generations=10, most_generations=100)
            assert sorted(i for b in best for i in b) == items and all(sum(lengths[i] for i in b) <= size for b in best)
        assert len(first) >= 46 and len(best) <= len(first) - 3


def test_crossover_keeps_whole_bins_and_every_item():
    rng = random.Random(1)
    lengths = [rng.randrange(20, 60) for _ in range(120)]
    a = packing.placed(list(range(120)), lengths, 100)
    b = packing.placed(packing.longest_first(list(range(120)), lengths), lengths, 100)
    before = [list(x) for x in a[0]], [list(x) for x in b[0]]
    child = packing.crossed(a, b, lengths, 100, rng, 3)
    assert sorted(i for x in child[0] for i in x) == list(range(120)) and child[1] == [sum(lengths[i] for i in x) for x in child[0]] and max(child[1]) <= 100
    assert any(x in b[0] for x in child[0]) and (a[0], b[0]) == before
    assert packing.evolve([100, 100, 3], 100, 1, None) == [[0], [1], [2]] and packing.evolve([], 100, 1, None) == []


def test_counts_with_prefixes_and_budgets(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Hello there, it's me"), (2, None), (3, "x" * 5000), (3, "")]
    got = token_counts.token_counts(frame(spark, rows), path, prefixes=True, budgets=(2,)).orderBy("doc_id").collect()
    theirs = Tokenizer.from_file(path)
    assert [r.n_tokens for r in got] == [len(theirs.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert rows[0][1][: got[0].fits_2] == "Hello there" and got[0].prefixes[-1] == got[0].n_tokens
    assert token_counts.token_counts(frame(spark, []), path).count() == 0


def test_texts_of_a_batch_have_the_ids_of_the_library():
    theirs, encoder = Tokenizer.from_file(PATH), pretokens.Encoder(PATH)
    found = [None, "", " ", "a", " two\twords\n", "a\x1cb \x1f", "<|endoftext|> x<|startoftext|>", "e\u0301 \u4e2d\u6587, ok", "it's 'S 1234 a,b", "a\x00b \x00", "w" * 5000, None]
    found += [x for c in map(chr, range(0x300)) for x in (c, f"A{c},b {c}{c}9", f"x {c}'s")] + texts(200, 9, 40)
    want = [theirs.encode(t or "", add_special_tokens=False).ids for t in found]
    for kind in (pa.string(), pa.large_string()):
        for block_bytes in (1, 700, 32_000_000):
            assert [x.tolist() for x in encoder.of_all(pa.array(found, kind), block_bytes)] == want
        assert [x.tolist() for x in encoder.of_all(pa.array(found, kind).slice(3, 50))] == want[3:53]
        assert [x.tolist() for x in encoder.of_all(pa.array([None, ""], kind))] == [[], []]
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    assert [x.tolist() for x in pretokens.Encoder(path).of_all(pa.array(found))] == [theirs.encode(t or "", add_special_tokens=False).ids for t in found]


def test_pieces_of_letters_whose_lower_case_lies_beyond_their_block(spark):
    theirs = Tokenizer.from_file(PATH)
    rows = [(c, f"a{chr(c)},b {chr(c)}'s {chr(c)}{chr(c)}9") for c in (0x130, 0x23A, 0x23E)]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(frame(spark, rows), PATH).collect()}
    want = {d: [*theirs.encode(t, add_special_tokens=False).ids, 1] for d, t in rows}
    assert got == {d: (len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for d, x in want.items()}


def test_packing_merges_each_distinct_word_of_a_batch_once(spark, monkeypatch):
    """Counted in the workers' own code, run here: words that are more than the encoder remembers come again and again."""
    encoder = pretokens.Encoder(PATH, most=10)
    merged, alone, flat, of_part = [], [], getattr(encoder, "flat", None), encoder.of_part
    encoder.flat = lambda text: merged.extend(text.split()) or flat(text)
    encoder.part = lambda part: alone.append(part) or of_part(part)
    monkeypatch.setattr(packing, "encoder", lambda path: encoder)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    made = []
    monkeypatch.setattr(packing, "map_batches", lambda df, make, ddl: made.append(make()))
    rows = [(i, " ".join(f"{chr(97 + j // 26)}{chr(97 + j % 26)}word" for j in range(i, i + 300))) for i in range(40)]
    packing.pieces(frame(spark, rows), PATH)
    got = made[0](pa.record_batch({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}))
    assert len(got["doc_id"]) == 40 and not alone
    assert sorted(merged) == sorted({w for _, t in rows for w in t.split()})
