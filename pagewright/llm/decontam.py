"""Benchmark decontamination: BM25 over the test items, block-max WAND for every passage, overlap to verify.

The index holds postings: for each term the items that have it, with its impact on each (BM25 with the passage as
query, over the least score that the item is retrieved at, so that every threshold is 1), and the same once more per
block of a few items, with the largest impact of each term in the block. Every document is read in overlapping passages,
many at once. Terms of a block are ordered by their largest impact: as long as these add up to less than 1 a passage
without any of the others can't reach the block. The term that reaches 1, and those behind it, are past the pivot, and
only their lists are walked: they give the pairs of passage and block that are looked at, all other blocks are skipped.
For those pairs the block's other terms follow, largest first, and a pair is dropped as soon as its sum and what could
still come stay below 1. The items of the blocks that are left are scored in full in the same way.

Passages follow the items' lengths: items of up to ``passage`` words are looked for in passages of that length, longer
ones in passages that hold the longest items of their band whole, wherever a copy begins.

A retrieved item counts as a leak when enough of the word shingles of its question (all but the last sentence) and
of its answer (the last sentence) stand in the passage and what surrounds it. Where one changed word would cost a short
part too many shingles, the part also counts by the words that stand in one place in order (1 - word edits / words).

The index travels to the executors, so its size is bounded: it grows with the items' words (some 60 bytes each), and
items come in shards of at most ``shard_words`` words. A larger benchmark is held against the documents shard by shard.

Defined results: null texts are empty and never leak; items without a word are no items; repeated documents give
repeated rows, repeated items one row each (ids apart); an empty table, or no items, gives no leaks.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_code
from .common import mapped


@dataclass(frozen=True)
class LeakParams:
    #: Items up to this length are looked for in passages of half as much again, begun at every half.
    passage: int = 64
    shingle: int = 5
    #: Share of an item's own score that a passage needs.
    threshold: float = 0.4
    #: Share of an item's shingles that must stand there.
    overlap: float = 0.8
    #: Items of a block.
    block: int = 4
    k1: float = 1.2
    b: float = 0.75
    #: Words of the items that one index holds.
    shard_words: int = 500_000
    #: Passages that are looked at together.
    at_once: int = 512


#: Everything of ASCII but letters and digits parts words.
TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(TO_WORDS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """All but the last sentence, and the last one; a single sentence is question and answer alike."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if words_of(p)]
    if len(parts) < 2:
        return words_of(text), words_of(text)
    return words_of(" ".join(parts[:-1])), words_of(parts[-1])


def shingle_set(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def containment(part: list[bytes], whole: list[bytes], n: int) -> float:
    """Share of the part's shingles that stand in the whole; parts shorter than a shingle need their words in order."""
    n = min(n, len(part))
    if not n:
        return 1.0
    own = shingle_set(part, n)
    there = {tuple(whole[i : i + n]) for i in range(len(whole) - n + 1)}
    return len(own & there) / len(own)


def in_one_place(part: list[bytes], whole: list[bytes]) -> float:
    """1 - edits / words, by the stretch of the whole that takes the fewest word edits to become the part."""
    n, places = len(part), {}
    for k, w in enumerate(part):
        places[w] = places.get(w, 0) | 1 << k
    # Myers' bit vectors: the differences between neighbours in a column of the edit table.
    every, last = (1 << n) - 1, 1 << n - 1
    up, down, edits = every, 0, n
    best = edits
    for w in whole:
        same = places.get(w, 0)
        rise = same | down
        level = (((same & up) + up) ^ up) | same
        more, less = (down | ~(level | up)) & every, up & level
        edits += bool(more & last) - bool(less & last)
        best = min(best, edits)
        more, less = more << 1 & every, less << 1 & every
        up, down = (less | ~(rise | more)) & every, more & rise
    return 1 - best / n


def share(part: list[bytes], whole: list[bytes], params: LeakParams) -> float:
    """How much of a part stands in the whole."""
    by_shingles, n = containment(part, whole, params.shingle), len(part)
    if by_shingles >= params.overlap or params.shingle <= (1 - params.overlap) * (n - params.shingle + 1):
        return by_shingles
    there = set(whole)
    if sum(w in there for w in part) < params.overlap * n:
        return by_shingles
    return max(by_shingles, in_one_place(part, whole))


class Lists:
    """Terms of groups of items: past each group's pivot as postings by term, before it by group, largest first.

    ``entries`` are group, term, weight with one row for each group and term; every group's threshold is 1.
    """

    def __init__(self, group: np.ndarray, term: np.ndarray, weight: np.ndarray, groups: int, terms: int, pivots: bool) -> None:
        order = np.lexsort((weight, group))
        group, term, weight = group[order], term[order], weight[order]
        ends = np.cumsum(np.bincount(group, minlength=groups))
        below = np.cumsum(weight) - np.concatenate([[0.0], np.cumsum(weight)])[np.concatenate([[0], ends])[group]]
        past = (below >= 1 - EPSILON) if pivots else np.zeros(len(group), bool)
        self.groups = groups
        # Past the pivot: by term.
        by_term = np.lexsort((group[past], term[past]))
        self.posting_group, self.posting_weight = group[past][by_term], weight[past][by_term]
        self.posting_end = np.cumsum(np.bincount(term[past], minlength=terms))
        # Before it: by group, largest first, with what the terms from here on can add.
        rest = np.flatnonzero(~past)[::-1]
        rest = rest[np.argsort(group[rest], kind="stable")]
        self.term, self.weight = term[rest], weight[rest]
        self.end = np.cumsum(np.bincount(group[rest], minlength=groups))
        self.to_come = below[rest]

    def walked(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """passage, group, sum for what the postings of these (distinct) pairs of passage and term reach."""
        end = self.posting_end[term]
        start = np.where(term > 0, self.posting_end[term - 1], 0)
        n = end - start
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        key, inverse = np.unique(np.repeat(passage, n) * self.groups + self.posting_group[at], return_inverse=True)
        return key // self.groups, key % self.groups, np.bincount(inverse, self.posting_weight[at], minlength=len(key))

    def reached(self, passage: np.ndarray, group: np.ndarray, total: np.ndarray, local: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs whose sum reaches 1 with the terms before the pivot that stand in the passage."""
        at, end = np.where(group > 0, self.end[group - 1], 0), self.end[group]
        done = [[], [], []]
        while len(passage):
            open_ = at < end
            over = ~open_ & (total >= 1 - EPSILON)
            for kept, x in zip(done, (passage, group, total), strict=True):
                kept.append(x[over])
            passage, group, total, at, end = (x[open_] for x in (passage, group, total, at, end))
            if not len(passage):
                break
            column = local[self.term[at]]
            total = total + self.weight[at] * ((column >= 0) & present[passage, column])
            alive = total + self.to_come[at] >= 1 - EPSILON
            passage, group, total, at, end = passage[alive], group[alive], total[alive], at[alive] + 1, end[alive]
        return tuple(np.concatenate(x) if x else np.empty(0, int) for x in done)


EPSILON = 1e-9


class Index:
    """One shard of items of like lengths: postings of items and of blocks of items, thresholds, texts to verify."""

    def __init__(self, items: list[tuple[int, str]], params: LeakParams) -> None:
        self.params = params
        seen: dict[bytes, int] = {}
        for own in (set(words_of(t)) for _, t in items):
            for w in own:
                seen[w] = seen.get(w, 0) + 1
        # Items with the same common words stand together, so that a block's largest impacts are near to each item's.
        items = sorted((i for i in items if words_of(i[1])), key=lambda i: sorted(set(words_of(i[1])), key=lambda w: (-seen[w], w))[:4])
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        words = [words_of(t) for _, t in items]
        self.lengths = [len(own) for own in words]
        self.terms = {w: k for k, w in enumerate(seen)}
        n = len(items)
        pairs = [(k, self.terms[w], c) for k, own in enumerate(words) for w, c in Counter(own).items()]
        item, term, tf = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, int),) * 3
        df = np.bincount(term, minlength=len(seen))[term]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = params.k1 * (1 - params.b + params.b * np.array(self.lengths, float) / max(1.0, sum(self.lengths) / max(1, n)))
        impact = idf * tf * (params.k1 + 1) / (tf + norm[item])
        #: The least score at which an item is retrieved.
        self.need = params.threshold * np.bincount(item, impact, minlength=n)
        weight = impact / self.need[item]
        self.items = Lists(item, term, weight, n, len(seen), pivots=False)
        blocks = -(-n // params.block)
        key, inverse = np.unique(item // params.block * len(seen) + term, return_inverse=True)
        largest = np.zeros(len(key))
        np.maximum.at(largest, inverse, weight)
        self.blocks = Lists(key // max(1, len(seen)), key % max(1, len(seen)), largest, blocks, len(seen), pivots=True)

    def retrieved(self, start: np.ndarray, size: np.ndarray, term: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """passage, item, score of all items that reach their threshold in passages of the term numbers."""
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        passage, own = np.repeat(np.arange(len(start)), size), term[at]
        passage, own = passage[own >= 0], own[own >= 0]
        known = np.unique(own)
        local[known] = np.arange(len(known))
        present = np.zeros((len(start), max(1, len(known))), bool)
        present[passage, local[own]] = True
        passage, own = np.nonzero(present)
        walked = self.blocks.walked(passage, known[own]) if len(known) else (np.empty(0, int),) * 3
        passage, block, _ = self.blocks.reached(*walked, local, present)
        # All items of the blocks that are left.
        passage, item = np.repeat(passage, self.params.block), (block[:, None] * self.params.block + np.arange(self.params.block)).ravel()
        passage, item = passage[item < len(self.ids)], item[item < len(self.ids)]
        passage, item, total = self.items.reached(passage, item, np.zeros(len(item)), local, present)
        local[known] = -1
        return passage, item, total * self.need[item]

    def leaks(self, texts: list[list[bytes]]) -> list[tuple[int, int, float, float, float, int]]:
        """text number, item_id, score, overlap of question and of answer, first word: the best passage of each item."""
        p, found = self.params, {}
        reach, stride = p.passage + p.passage // 2, max(1, p.passage // 2)
        number = self.terms.get
        local = np.full(len(self.terms), -1)
        for first, last in batches_of([max(1, -(-(len(w) - reach) // stride) + 1) for w in texts], p.at_once):
            own = texts[first : last + 1] if isinstance(last, int) else [texts[first]]
            low, high = (0, None) if isinstance(last, int) else last
            starts, sizes, ends, term, at = [], [], [], [], 0
            for k, words in enumerate(own):
                begun = np.arange(0, max(1, len(words) - reach + stride), stride)[low:high]
                cut = words[begun[0] : begun[-1] + reach]
                term += [number(w, -1) for w in cut]
                starts.append(begun - begun[0] + at)
                sizes.append(np.minimum(reach, len(words) - begun))
                ends += [(first + k, b) for b in begun.tolist()]
                at += len(cut)
            passages = self.retrieved(np.concatenate(starts), np.concatenate(sizes), np.array(term, int), local)
            for w, item, score in sorted(zip(*(x.tolist() for x in passages), strict=True), key=lambda x: (x[0], x[1])):
                text, start = ends[w]
                if (text, item) in found and found[text, item][2] >= score:
                    continue
                around = texts[text][max(0, start - self.lengths[item]) : start + reach + self.lengths[item]]
                question, answer = self.parts[item]
                if (q := share(question, around, p)) >= p.overlap and (a := share(answer, around, p)) >= p.overlap:
                    found[text, item] = (text, self.ids[item], score, q, a, start)
        return [found[k] for k in sorted(found)]


def batches_of(passages: list[int], at_once: int):
    """(first, last) number of texts with some ``at_once`` passages together; (number, (low, high)) for pieces of a long one."""
    first, size = 0, 0
    for k, n in enumerate(passages):
        if n > at_once:
            if first < k:
                yield first, k - 1
            for low in range(0, n, at_once):
                yield k, (low, low + at_once)
            first, size = k + 1, 0
            continue
        size += n
        if size >= at_once:
            yield first, k
            first, size = k + 1, 0
    if first < len(passages):
        yield first, len(passages) - 1


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def shards(items: DataFrame, params: LeakParams):
    """The items in lists of bounded size, one list at a time."""
    own, size = [], 0
    for row in items.select("item_id", "text").filter("text is not null and item_id is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        own.append((row["item_id"], row["text"]))
        size += len(words_of(row["text"]))
        if size >= params.shard_words:
            yield own
            own, size = [], 0
    if own:
        yield own


def indexes(shard: list[tuple[int, str]], params: LeakParams) -> list[Index]:
    """An index for each band of lengths: up to a passage, up to two, up to four and so on.

    A passage of one and a half times the longest item, begun at every half of it, holds any copy whole.
    """
    bands: dict[int, list[tuple[int, str]]] = {}
    for item in shard:
        longest = params.passage
        while longest < len(words_of(item[1])):
            longest *= 2
        bands.setdefault(longest, []).append(item)
    return [Index(bands[n], replace(params, passage=n)) for n in sorted(bands)]


def leaks(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """A row for each document and item that leaks into it."""

    def against(own: list[Index]):
        def run(batches):
            for batch in batches:
                ids, words = batch["doc_id"].tolist(), [words_of(t) for t in batch["text"]]
                rows = [(ids[k], *hit) for index in own for k, *hit in index.leaks(words)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAKS.split(", ")])

        return run

    found = docs.sparkSession.createDataFrame([], LEAKS)
    for shard in shards(items, params):
        found = found.unionByName(mapped(docs, against(indexes(shard, params)), LEAKS))
    return found


def clean(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns: decided where the text is read, without a join."""
    with_code(docs.sparkSession)

    def against(own: list[Index]):
        def leaky(text: pd.Series) -> pd.Series:
            words, out = [words_of(t or "") for t in text], np.zeros(len(text), bool)
            for index in own:
                out[[hit[0] for hit in index.leaks(words)]] = True
            return pd.Series(out)

        return F.pandas_udf(leaky, "boolean")(F.coalesce("text", F.lit("")))

    for shard in shards(items, params):
        docs = docs.filter(~against(indexes(shard, params)))
    return docs
