"""Splitting text into the pieces that the two BPE vocabularies merge within.

Texts of characters below U+0300 are split by a pattern of Python's ``re``: no character there composes, and their
classes are fixed. Other texts are split by the tokenizers library's own normalizer and splitter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from ledgerlight.llm.common import Recent

_LOW = [chr(i) for i in range(0x300)]
_L = "".join(map(re.escape, (c for c in _LOW if unicodedata.category(c)[0] == "L")))
_N = "".join(map(re.escape, (c for c in _LOW if unicodedata.category(c)[0] == "N")))
#: White space as in Unicode, unlike Python's \s, which holds U+001C to U+001F too.
_S = "\t-\r \x85\xa0"
#: Beyond them, and the letters below that aren't in lower case: one becomes two, two lie beyond.
_HIGH = re.compile("[^\x00-\u02ff]|[\u0130\u023a\u023e]")
_MARKS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS = re.compile(f"[{_L}]+|{_MARKS}|[{_N}]|[^{_S}{_L}{_N}]+")
#: A line break, which no word holds, stands between words that are split together.
_WORDS_IN_LINES = re.compile(f"{_WORDS.pattern}|\n")
_BYTES = re.compile(f" ?[{_L}]+|{_MARKS}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Parts between white space, whose pieces don't depend on what stands around them.
_WORD_PARTS = re.compile(f"[^{_S}]+")
_BYTE_PARTS = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Splitter:
    """Pieces of a text as the tokenizer at ``path`` sees them; added tokens are pieces of their own, given as ints."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip, stand alone or are normalized aren't supported")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = bool(spec["model"].get("end_of_word_suffix"))
        self.find = (_WORDS if self.words else _BYTES).findall
        #: Texts that Arrow doesn't split as here, in RE2's syntax: _HIGH, added tokens, and white space to Arrow that is none in Unicode.
        self.odd = "|".join(["[^\x00-\u02ff]|[\u0130\u023a\u023e\x1c-\x1f]", *map(re.escape, self.added)])

    def parts(self, text: str) -> list[str]:
        """Parts of a text without added tokens, each of which splits into the same pieces wherever it stands."""
        t = self.tokenizer
        if _HIGH.search(text):
            if t.normalizer:
                text = t.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)]
        # below U+0300 lower() is the simple mapping, one character each
        return _WORD_PARTS.findall(text.lower()) if self.words else _BYTE_PARTS.findall(text)

    def split(self, part: str) -> list[str]:
        return self.find(part) if part.isascii() or not _HIGH.search(part) else [part]

    def plain(self, text: str) -> list[str]:
        """Pieces of a text without added tokens."""
        return list(chain.from_iterable(map(self.split, self.parts(text))))

    def cut_up(self, text: str, of) -> list[str | int]:
        """of() of the text between added tokens, which stand as ints."""
        if self.cut is None or not self.cut.search(text):
            return of(text)
        return list(chain.from_iterable([self.added[s]] if s in self.added else of(s) for s in self.cut.split(text) if s))

    def all_parts(self, text: str) -> list[str | int]:
        return self.cut_up(text, self.parts)

    def pieces(self, text: str) -> list[str | int]:
        return self.cut_up(text, self.plain)


@lru_cache(2)
def splitter(path: str) -> Splitter:
    """Kept for the life of a Python worker."""
    return Splitter(path)


@lru_cache(2)
def merger(path: str) -> tuple[tiktoken.Encoding, bytes]:
    """The same merges by rank on bytes, and the byte that ends a word: a space, which no word holds.

    Its encode_ordinary() takes words with their ends, one after the other. A word's end is merged into its last byte first, since those tokens have lower ids than all merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    vocab, suffix = spec["vocab"], spec.get("end_of_word_suffix") or ""
    made = [vocab[x.replace(" ", "", 1) if isinstance(x, str) else "".join(x)] for x in spec["merges"]]
    if made != sorted(made) or len(vocab) - len(made) not in (256, 512):
        raise ValueError("ids that don't follow the order of merges aren't supported")
    to_byte = byte_alphabet()
    ranks = {}
    for s, i in vocab.items():
        ends = bool(suffix) and s.endswith(suffix)
        ranks[bytes(to_byte[c] for c in (s[: -len(suffix)] if ends else s)) + b" " * ends] = i
    if len(ranks) < len(vocab):
        raise ValueError("tokens of words that hold a space aren't supported")
    return tiktoken.Encoding("own", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), b" " if suffix else b""


class Encoder:
    """Ids of texts; parts met lately aren't encoded again."""

    def __init__(self, path: str, most: int = 150_000) -> None:
        self.splitter = splitter(path)
        encoding, self.end = merger(path)
        self.merge, self.flat = encoding._encode_single_piece, encoding.encode_ordinary
        self.as_bytes = [i.to_bytes(4, "little") for i in range(self.splitter.tokenizer.get_vocab_size())]
        self.line = self.merge(b"\n" + self.end)[0]
        self.part = Recent(self.of_part, most).__getitem__

    def of_part(self, part: str | int) -> bytes:
        if isinstance(part, int):
            return self.as_bytes[part]
        return b"".join([self.as_bytes[i] for p in self.splitter.split(part) for i in self.merge(p.encode("utf-8", "surrogatepass") + self.end)])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.part, self.splitter.all_parts(text))), "<u4")

    def of_all(self, texts: pa.Array, block_bytes: int = 4_000_000) -> Iterator[np.ndarray]:
        """Ids of each text (null: none), in blocks of about so many bytes: each distinct word of a block is split and merged once."""
        if not self.splitter.words:
            yield from (self.ids(t or "") for t in texts.to_pylist())
            return
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(ends // block_bytes)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
            yield from self.of_block(texts.slice(a, b - a))

    def of_block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.splitter.odd)
        words = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        at, found = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        del words
        ids, starts = self.of_words(found.dictionary)
        index, lengths = found.indices.to_numpy(), np.diff(starts) - 1  # without the line break
        for k, other in enumerate(odd.to_pylist()):
            if other:
                yield self.ids(texts[k].as_py())
                continue
            own = index[at[k] : at[k + 1]]
            n = lengths[own]
            ends = np.cumsum(n)
            # a word's ids stand side by side: where they are taken from, less where they go to, is one number
            yield ids[np.repeat(starts[own] - ends + n, n) + np.arange(ends[-1])]

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with that of a line break behind it, and where each word's begin, and all end."""
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        ids = np.array(self.flat(" ".join([*_WORDS_IN_LINES.findall(lines), "\n", ""])), "<u4")
        starts = np.concatenate([[0], np.flatnonzero(ids == self.line) + 1])
        return ids, starts


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """Kept for the life of a Python worker."""
    return Encoder(path)


@lru_cache(2)
def byte_alphabet() -> dict[str, int]:
    """Byte by the character that stands for it in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


__all__ = ["Encoder", "Splitter", "byte_alphabet", "encoder", "merger", "splitter"]
