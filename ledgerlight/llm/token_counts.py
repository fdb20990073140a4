"""Token counts by dynamic programming over prefixes.

For a byte-pair vocabulary in which each token encodes to itself, every prefix of a piece has one encoding, and its
last token is the only token t that ends there and stands well after the last token of the prefix before t. So
``count[i] = count[i - len(t)] + 1`` gives the exact count at every prefix in one pass, and questions on truncation
or budgets are lookups, without encoding again.

Nulls: a null text counts as empty (0 bytes, 0 tokens). Rows are answered one by one: repeated rows give repeated
results, an empty table an empty one, and columns other than the named ones are ignored. Long texts are whole.
"""

from __future__ import annotations

import bisect
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import Recent, map_batches
from ledgerlight.llm.pretokens import merger, splitter

_BROKEN = {"'r", "'v", "'l"}  # begun contractions split in two


class PrefixCounter:
    """Counts at every prefix for the byte-level vocabulary at ``path``."""

    def __init__(self, path: str) -> None:
        self.splitter = splitter(path)
        encoding, end = merger(path)
        if end:
            raise ValueError("vocabularies with word ends aren't supported: a prefix of a word has another end")
        self.ids = encoding._mergeable_ranks
        self.longest = max(map(len, self.ids))
        self.token = {i: b for b, i in self.ids.items()}
        self.merge = encoding._encode_single_piece
        self.fits = Recent(lambda ab: self.merge(self.token[ab[0]] + self.token[ab[1]]) == [*ab])
        self.piece = Recent(lambda p: self.of_bytes(p.encode("utf-8", "surrogatepass"))[-1])
        self.totals = Recent(lambda p: 1 if isinstance(p, int) else sum(map(self.piece.__getitem__, self.splitter.split(p))))

    def of_bytes(self, piece: bytes) -> list[int]:
        """Counts at each byte of one piece, 0 at its start."""
        n, ids, fits, longest = len(piece), self.ids, self.fits, self.longest
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                t = ids.get(piece[j:i])
                if t is not None:
                    if j == 0 or fits[last[j], t]:
                        last[i], count[i] = t, count[j] + 1
                        break
        return count

    def total(self, part: str | int) -> int:
        """Tokens of a part of a text or of an added token."""
        return self.totals[part]

    def count(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.splitter.all_parts(text)))

    def piece_prefixes(self, piece: str) -> list[int]:
        """Counts after each character of a piece, each prefix taken as a text of its own."""
        counts = self.of_bytes(piece.encode("utf-8", "surrogatepass"))
        at = accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)
        out = [counts[i] for i in at]
        for i in range(1, len(piece) + 1):
            if piece[:i] in _BROKEN and len(piece) > i:
                out[i - 1] = 2
        return out

    def prefixes(self, text: str) -> list[int]:
        """Exact count of every prefix, by characters; entry 0 is the empty prefix."""
        out, base = [0], 0
        for part in self.splitter.cut.split(text) if self.splitter.cut else [text]:
            if part in self.splitter.added:
                # an unfinished added token is ordinary text that may join the piece before it
                run = text[: len(out) - 1]
                start = max((run.rfind(s) + len(s) for s in self.splitter.added if s in run), default=0)
                plain, whole = run[start:], self.count(run[:start])
                for i in range(1, len(part)):
                    out.append(whole + sum(map(self.total, self.splitter.parts(plain + part[:i]))))
                base += 1
                out.append(base)
                continue
            pieces = self.splitter.plain(part)
            for k, piece in enumerate(pieces):
                inner = self.piece_prefixes(piece)
                if k and pieces[k - 1].isspace() and piece[0].isspace():
                    # a run of white space is one piece until a word takes its last character
                    before = base - self.total(pieces[k - 1])
                    inner[0] = before + self.total(pieces[k - 1] + piece[0]) - base
                out += [base + x for x in inner]
                base += self.total(piece)
        return out


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def cut_to(prefixes: list[int], budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens. Counts of prefixes can fall by a step, so the last that fits is looked for."""
    i = bisect.bisect_right(list(accumulate(reversed(prefixes), min))[::-1], budget)
    return max(0, i - 1)


def token_counts(df: DataFrame, path: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False, budgets: tuple[int, ...] = ()) -> DataFrame:
    """One row per row: id, n_bytes, n_tokens, over_limit; with ``prefixes`` the counts at every character (array),
    and for each of ``budgets`` the characters that fit, as fits_<budget>, read off those counts."""
    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean" + ", prefixes array<int>" * prefixes + "".join(f", fits_{b} bigint" for b in budgets)

    def make():
        c = counter(path)

        def of(batch):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            stored = [c.prefixes(t) for t in texts] if prefixes or budgets else None
            n = [p[-1] for p in stored] if stored is not None else [c.count(t) for t in texts]
            out = {id_col: batch.column(0), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}
            return out | {"prefixes": stored} | {f"fits_{b}": [cut_to(p, b) for p in stored or ()] for b in budgets}

        return of

    return map_batches(df.select(F.col(id_col), F.col(text_col)), make, ddl)
