"""Exact token counts by prefix dynamic programming over byte-pair encodings.

The last token of a text's encoding decides how the text before it was encoded: token t may follow token s exactly
when the encoder, given the bytes of both, returns s and t again. So the encoding of a prefix is that of a shorter
prefix plus the one token that may follow, and a word's list of states (tokens and last token at each of its prefixes)
fills in from left to right: one whole number a byte, however long the word is. Words are what the pre-tokenizer cuts
out, which no token crosses; a text's count at any prefix is the sum of the whole words before it plus one look into
the list of the word that it cuts. Truncation to a budget is a search in the same sums. Nothing is encoded again.

Words come from the pre-tokenizer's public pattern. A text that holds a special token's string is cut there first,
as the library does by default, and each such string counts one.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts are counted whole whatever their length;
repeated rows give repeated results; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from .common import mapped

VOCABULARY = "byte_bpe_50k"
#: Entries that each of a worker's three tables keeps before it starts anew, the bytes of the longest prefix and the
#: characters of the longest run that are kept: together they bound a worker's memory and change no result.
TABLE_SIZE = 500_000
KEPT_BYTES = 24
KEPT_CHARS = 64


def ranks_path(name: str = VOCABULARY) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.path(f"{name}.json")


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY):
    """The byte-pair encoder of the vocabulary, its ranks, and the special tokens with their ids."""
    import public_tokenizers
    import tiktoken

    ranks_file, json_file = ranks_path(name)
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_file, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks, special


class PrefixCounter:
    """Counts and last tokens at every prefix of a word; those of short prefixes and runs are kept, in bounded tables."""

    def __init__(self, name: str = VOCABULARY, table_size: int = TABLE_SIZE) -> None:
        import public_tokenizers
        import regex

        self.bpe, self.ranks, self.special = encoder(name)
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.piece = self.bpe._encode_single_piece
        self.token = {v: k for k, v in self.ranks.items()}
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.table_size = table_size
        self.chunks: dict[str, int] = {}
        self.follows: dict[int, bool] = {}
        #: short prefix of a word -> tokens << 20 | last token
        self.prefixes: dict[bytes, int] = {}

    def may_follow(self, key: int) -> bool:
        """Whether the encoder keeps the tokens of ``key`` (first << 20 | second) apart; asked once for each pair."""
        if len(self.follows) >= self.table_size:
            self.follows.clear()
        first, second = key >> 20, key & 0xFFFFF
        known = self.follows[key] = self.piece(self.token[first] + self.token[second]) == [first, second]
        return known

    def states(self, word: bytes) -> list[int]:
        """Tokens << 20 | last token for each prefix of a word, from the empty one on: linear in the word.

        One token and no other fits behind the prefix before it, so the order in which they are asked is free.
        """
        n, table, ranks, follows = len(word), self.prefixes, self.ranks.get, self.follows.get
        if len(table) >= self.table_size:
            table.clear()
        have = min(n, KEPT_BYTES)
        while have and word[:have] not in table:
            have -= 1
        out = [0, *[table[word[:k]] for k in range(1, have + 1)]]
        for end in range(have + 1, n + 1):
            for start in range(end - 1, -1, -1):
                token = ranks(word[start:end])
                if token is None:
                    continue
                before = out[start]
                if start:  # a vocabulary entry is its own encoding, others must follow what stands before them
                    key = (before & 0xFFFFF) << 20 | token
                    known = follows(key)
                    if not (self.may_follow(key) if known is None else known):
                        continue
                state = (before >> 20) + 1 << 20 | token
                break
            out.append(state)
            if end <= KEPT_BYTES:
                table[word[:end]] = state
        return out

    def word_count(self, word: str) -> int:
        raw = word.encode()
        known = self.prefixes.get(raw)
        return (self.states(raw)[-1] if known is None else known) >> 20

    def chunk_count(self, chunk: str) -> int:
        """Tokens of a run that the pre-tokenizer treats alike wherever it stands."""
        n = sum(map(self.word_count, self.words(chunk)))
        if len(chunk) <= KEPT_CHARS:
            if len(self.chunks) >= self.table_size:
                self.chunks.clear()
            self.chunks[chunk] = n
        return n

    #: White space and what stands after it up to the next white space: no word of the pre-tokenizer crosses its ends.
    runs = re.compile(r"\s*\S+|\s+")

    def ordinary_count(self, text: str) -> int:
        chunks = self.runs.findall(text)
        counts = list(map(self.chunks.get, chunks))
        if None in counts:
            return sum(self.chunk_count(c) if n is None else n for c, n in zip(chunks, counts, strict=True))
        return sum(counts)

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        if not any(s in text for s in self.special):
            return self.ordinary_count(text)
        return sum(1 if special else self.ordinary_count(part) for part, special in self.segments(text))

    def prefix_index(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """The words of a text, where each ends (code points), and the tokens up to there."""
        words, ends, sums, at, n = [], [], [], 0, 0
        for part, special in self.segments(text):
            for word in [part] if special else self.words(part):
                at += len(word)
                n += 1 if special else self.word_count(word)
                words.append(word)
                ends.append(at)
                sums.append(n)
        return words, ends, sums

    def truncate(self, text: str, budget: int) -> str:
        """The longest run of whole words from the start, then of whole characters, within ``budget`` tokens."""
        words, ends, sums = self.prefix_index(text)
        k = bisect_right(sums, budget)
        at, used = (ends[k - 1], sums[k - 1]) if k else (0, 0)
        if k < len(words) and words[k] not in self.special:
            word = words[k]
            states = self.states(word.encode())
            ends_at = [0, *accumulate(len(c.encode()) for c in word)]
            at += next((i for i in range(len(word), 0, -1) if used + (states[ends_at[i]] >> 20) <= budget and self.words(word[:i]) == [word[:i]]), 0)
        return text[:at]


@lru_cache(maxsize=1)
def counter(name: str) -> PrefixCounter:
    """One counter for each Python worker."""
    return PrefixCounter(name)


def token_counts(docs: DataFrame, limit: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""

    def count(batches):
        own = counter(vocabulary)
        for batch in batches:
            n = [own.count(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(t.encode()) for t in batch["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]})

    return mapped(docs, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
