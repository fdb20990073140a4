import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlight.llm.pretokens import Encoder
from ledgerlight.llm.token_counts import PrefixCounter, cut_to

ODD = ["'", "'s", "'re", "'l", " ", "  ", "\n", "\t", "a", "the", "ing", "é", "日", "1", "22", "!!", "<|endoftext|>", "<|endo", "　", "é", "Ab", "\x1c", "\x85", "🙂", ".", "İ", "Σ", "ΑΣ", "<|startoftext|>", "ﬁ"]


def texts(n, seed, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    path = public_tokenizers.path(name)
    ours, theirs = Encoder(path), Tokenizer.from_file(path)
    for s in texts(1500, 1):
        assert ours.ids(s).tolist() == theirs.encode(s, add_special_tokens=False).ids, s


def test_count_at_every_prefix():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs = PrefixCounter(path), Tokenizer.from_file(path)
    for s in texts(400, 2):
        want = [len(theirs.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        assert ours.prefixes(s) == want, s
        assert ours.count(s) == want[-1]
        for budget in (0, 1, 3, 100):
            fit = cut_to(want, budget)
            assert want[fit] <= budget and all(x > budget for x in want[fit + 1 :])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_entry_of_the_vocabulary_encodes_to_itself(name):
    """What merging by rank relies on."""
    model = Tokenizer.from_file(public_tokenizers.path(name)).model
    vocab = Tokenizer.from_file(public_tokenizers.path(name)).get_vocab(with_added_tokens=False)
    assert name and not [s for s, i in vocab.items() if not s.endswith("</w>") and name[0] == "b" and [t.id for t in model.tokenize(s)] != [i]]
    ends = [(s, i) for s, i in vocab.items() if s.endswith("</w>")]
    assert not [s for s, i in ends if [t.id for t in model.tokenize(s[:-4])] != [i]]
