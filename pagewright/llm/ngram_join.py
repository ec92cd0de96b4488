"""N-gram Jaccard join: pairs of texts whose sets of word shingles are alike, and the groups that they link.

Every shingle toggles one bit of its text's sketch. A sketch has blocks; for each block a 64-bit digest (XOR of the
hashes of its shingles) says whether two blocks are the same, and folded copies of the whole sketch are kept too: a
narrow one of 512 bits, a wide one that grows with the set (a power of two, at least two bits a shingle). Folding a
sketch in half is the XOR of its halves, so sketches of different widths compare at the narrower one. The Hamming
distance of two folded sketches never exceeds the symmetric difference of the sets.

Sets with Jaccard >= t differ in at most d = (1-t)/(1+t) * (|A|+|B|) shingles. Pairs are banded by the size of their
smaller set; a band's sketches have d + 1 + EMPTY + SPARE blocks, so alike sets agree on more than EMPTY + SPARE of
them. Texts with at most EMPTY empty blocks leave those out, and every text leaves out the SPARE digests of a band
that most sets have (equal counts by digest): of the digests that two alike sets share, the one that fewest sets have is
left out by neither. So a passage that many documents share, or the frequent words of a language, seldom bring texts
together. Texts meet on the digests that are left: first each with the smallest of its bucket, then, for buckets that
still hold several groups, the pairs of different groups whose Hamming distance allows a link; those are compared
inside the join and not emitted otherwise. Each candidate is verified on the shingles themselves. That finds every link
that changes a group, without all pairs of a group of copies; equal sets were one row from the start.

Groups are found by alternating hooks to the smallest neighbour. All of it is joins and aggregates whose rows
survive in the shared folder.

Defined results: null and empty texts have no shingles and link with nothing; a text of fewer words than a shingle
is one shingle; repeated rows are equal sets and so in one group; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, mapped, texts


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    #: The threshold, as percent, so that the verdict is exact in whole numbers; 93 or less, as a key has seven bits for bands.
    percent: int = 80
    #: Blocks that alike sets share beyond the one that the pigeonhole promises: for empty ones, and a share for common ones.
    empty: int = 2
    common: float = 0.2
    #: Shingles of the texts that are verified with one text in one go.
    verified_shingles: int = 20_000
    #: 64-bit words of the narrow folded sketch, a power of two.
    folded: int = 8

    def __post_init__(self) -> None:
        if not 1 <= self.percent <= 93 or self.words < 1:
            raise ValueError("percent must be from 1 to 93 and words 1 or more")

    @property
    def band(self) -> float:
        """Sizes of a band reach from one power of this to the next."""
        return 1 + 3 * (100 - self.percent) / 100

    def geometry(self, band: int) -> tuple[int, int]:
        """Blocks of a band's sketches, and how many digests a text leaves out there."""
        top = int(np.ceil(self.band ** (band + 1))) - 1
        least = bound(top + top * 100 // self.percent, self.percent) + 1
        spare = int(self.common * least) + 1
        return least + self.empty + spare, spare


#: Sets are of at most so many shingles (a text of tens of GB).
LARGEST = 10**10
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles; A to Z are lower-cased, white space is ASCII's."""
    import xxhash

    own = text.encode().lower().split()
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    n = max(1, len(own) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(own))):
        out = mixed(out * np.uint64(3) + h[k : k + n] + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64)))
    return np.unique(out)


def bound(sizes: int, percent: int) -> int:
    """The largest symmetric difference of alike sets whose sizes add up to this."""
    return sizes * (100 - percent) // (100 + percent)


def band_of(n: int, params: JoinParams) -> int:
    k = int(np.log(n) / np.log(params.band))
    while params.band ** (k + 1) <= n:
        k += 1
    while params.band**k > n:
        k -= 1
    return k


#: Bits of a key that hold the digest; the band stands above them.
DIGEST_BITS = 56


def keys(h: np.ndarray, params: JoinParams) -> np.ndarray:
    """The digests under which a set stands: in its own band, and in those that smaller alike sets can be in."""
    n, out = len(h), []
    spread = mixed(h ^ MIX) >> np.uint64(32)
    for band in range(band_of(-(-n * params.percent // 100), params), band_of(n, params) + 1):
        blocks, _ = params.geometry(band)
        block = (spread % np.uint64(blocks)).astype(np.intp)
        digest = np.zeros(blocks, np.uint64)
        np.bitwise_xor.at(digest, block, h)
        full = np.bincount(block, minlength=blocks) > 0
        key = mixed(digest ^ mixed(np.arange(blocks, dtype=np.uint64))) >> np.uint64(64 - DIGEST_BITS) | np.uint64(band << DIGEST_BITS)
        out.append(key if (~full).sum() > params.empty else key[full])
    return np.concatenate(out).view(np.int64)


def folded(h: np.ndarray, words: int) -> np.ndarray:
    bits = mixed(h + MIX) & np.uint64(64 * words - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (bits >> np.uint64(6)).astype(np.intp), np.uint64(1) << (bits & np.uint64(63)))
    return out.view(np.int64)


def width(n: int, params: JoinParams) -> int:
    """Words of the wide sketch of a set of this size."""
    return max(params.folded, 1 << (-(-n // 32) - 1).bit_length())


def sketches(docs: DataFrame, params: JoinParams) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint, folded sketch and keys."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                h = shingles(text, params.words)
                if len(h):
                    rows.append((doc_id, len(h), int(np.bitwise_xor.reduce(h).view(np.int64)), int(mixed(h).sum(dtype=np.uint64).view(np.int64)), folded(h, params.folded), folded(h, width(len(h), params)), keys(h, params)))
                else:
                    rows.append((doc_id, 0, 0, 0, [], [], []))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "print1", "print2", "sketch", "wide", "keys"])

    return mapped(docs, run, "doc_id long, n_shingles long, print1 long, print2 long, sketch array<long>, wide array<long>, keys array<long>")


def verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch, name: str, params: JoinParams) -> DataFrame:
    """The pairs (a, b, shingles of b) whose Jaccard reaches the threshold, written.

    Pairs of one ``a`` come together, ``a``'s text once for each ``verified_shingles`` of their shingles.
    """
    pairs = scratch.write(pairs, f"{name}-found")
    parts = F.ceil(F.sum("b_n") / params.verified_shingles).cast("long")
    dealt = pairs.join(pairs.groupBy("a").agg(parts.alias("parts")), "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("salt"))
    pairs = scratch.write(dealt, f"{name}-pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    own = scratch.write(texts(docs).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), f"{name}-texts")
    left = pairs.select(F.col("a").alias("a"), F.col("salt").alias("salt")).distinct().join(own.withColumnsRenamed({"doc_id": "a", "text": "a_text"}), "a")
    right = pairs.join(own.withColumnsRenamed({"doc_id": "b", "text": "b_text"}), "b")

    def run(lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
        if lefts.empty or rights.empty:
            return pd.DataFrame({"a": [], "b": []})
        a, ours = int(lefts["a"].iloc[0]), shingles(lefts["a_text"].iloc[0], params.words)
        found = []
        for b, text in zip(rights["b"], rights["b_text"], strict=True):
            other = shingles(text, params.words)
            shared = len(np.intersect1d(ours, other, assume_unique=True))
            if 100 * shared >= params.percent * (len(ours) + len(other) - shared):
                found.append(b)
        return pd.DataFrame({"a": [a] * len(found), "b": found})

    links = left.groupBy("a", "salt").cogroup(right.groupBy("a", "salt")).applyInPandas(run, "a long, b long")
    links = scratch.write(links, f"{name}-links")
    scratch.drop(f"{name}-found", f"{name}-pairs", f"{name}-texts")
    return links


def components(edges: DataFrame, scratch: Scratch | None = None, name: str = "groups") -> DataFrame:
    """node, component (its smallest node) for rows a, b; nodes without an edge aren't returned.

    Large-star and small-star in turn, until nothing moves: each needs one aggregate and one join.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges, turn = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{name}-0"), 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = scratch.write(large, f"{name}-{turn}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = scratch.write(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), f"{name}-{turn + 1}")
        still = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        scratch.drop(f"{name}-{turn}", f"{name}-{turn}-large")
        edges, turn = small, turn + 1
        if still:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", F.col("v").alias("component")).distinct())


def allowed(a: str, b: str, params: JoinParams) -> Column:
    """What sizes and folded sketches of two sets tell: can they be alike?"""
    p = params.percent
    distance = " + ".join(f"bit_count({a}_sketch[{k}] ^ {b}_sketch[{k}])" for k in range(params.folded))
    return F.expr(f"100 * least({a}_n, {b}_n) >= {p} * greatest({a}_n, {b}_n) and {100 + p} * ({distance}) <= {100 - p} * ({a}_n + {b}_n)")


def allowed_wide(params: JoinParams) -> Column:
    """The same of the wide sketches; the wider one is folded down first."""
    p = params.percent
    halved = "transform(sequence(1, size({0}) div 2), i -> {0}[i - 1] ^ {0}[size({0}) div 2 + i - 1])"
    a, b = (f"if(size({x}) > size({y}), {halved.format(x)}, {x})" for x, y in (("a_wide", "b_wide"), ("b_wide", "a_wide")))
    distance = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    same = "greatest(size(a_wide), size(b_wide)) <= 2 * least(size(a_wide), size(b_wide))"
    return F.expr(f"not ({same}) or {100 + p} * ({distance}) <= {100 - p} * (a_n + b_n)")


def stars_and_buckets(rows: DataFrame, scratch: Scratch, params: JoinParams) -> DataFrame:
    """key, a (the smallest set that has it), b (a set that has it) for the digests on which sets meet; written."""
    stands = rows.select("id", F.explode("keys").alias("key"))
    shared = scratch.write(stands.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("sets")).filter("a != z").select("key", "sets"), "shared")
    # By sort and merge at every size, so that small inputs tell how large ones behave.
    held = stands.join(shared.hint("merge"), "key").select("key", F.col("id").alias("b"), "sets")
    # Each text leaves out its most common digests; among the texts that are left the smallest counts anew.
    band = F.shiftright("key", DIGEST_BITS)
    spare = F.element_at(F.array(*[F.lit(params.geometry(k)[1]) for k in range(band_of(LARGEST, params) + 1)]), band.cast("int") + 1)
    own = Window.partitionBy("b", band).orderBy(F.desc("sets"), "key")
    # What no other set has comes last, so the digests that several share fill the spare places first.
    held = held.withColumn("place", F.row_number().over(own)).filter(F.col("place") > spare)
    held = scratch.write(held.select("key", "b"), "held")
    scratch.drop("shared")
    least = held.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("z")).filter("a != z").select("key", "a")
    met = scratch.write(held.join(least.hint("merge"), "key").select("key", "a", "b"), "met")
    scratch.drop("held")
    return met


def ngram_groups(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = scratch.write(sketches(docs, params), "sketches")
    # Written, so that a set of very many copies meets its rows in a join that can be split.
    sets = scratch.write(rows.filter("n_shingles > 0").groupBy("print1", "print2", "n_shingles").agg(F.min("doc_id").alias("set_id")), "sets")
    member = scratch.write(rows.select("doc_id", "print1", "print2", "n_shingles").join(sets, ["print1", "print2", "n_shingles"], "left").select("doc_id", "n_shingles", "set_id"), "members")
    # One row for each distinct set stands for it from here on.
    doubles = member.filter("doc_id != set_id").select("doc_id").distinct()
    own = rows.filter("n_shingles > 0 and doc_id is not null").join(doubles, "doc_id", "left_anti").withColumnsRenamed({"doc_id": "id", "n_shingles": "n"})
    own = scratch.write(own.select("id", "n", "sketch", "wide", "keys").dropDuplicates(["id"]), "own")
    scratch.drop("sketches", "sets")
    met = stars_and_buckets(own, scratch, params)
    small = own.drop("keys")

    def with_sketch(pairs: DataFrame, side: str, *columns: str) -> DataFrame:
        return pairs.join(small.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)

    def sifted(pairs: DataFrame) -> DataFrame:
        """The pairs that their wide sketches allow."""
        return with_sketch(with_sketch(pairs, "a", "n", "wide"), "b", "n", "wide").filter(allowed_wide(params)).select("a", "b", "b_n")

    stars = met.filter("a != b").select("a", "b").distinct()
    stars = with_sketch(with_sketch(stars, "a", "n", "sketch"), "b", "n", "sketch").filter(allowed("a", "b", params)).select("a", "b")
    stars = scratch.write(stars, "stars")
    links = verified(docs, sifted(stars), scratch, "star", params)
    # Buckets that still hold several groups: pairs of different groups, as far as the sketches allow a link.
    group = scratch.write(components(links, scratch, "first"), "first")
    named = scratch.write(met.join(group, F.col("b") == F.col("node"), "left").select("key", F.col("b").alias("id"), F.coalesce("component", "b").alias("component")), "named")
    scratch.drop("met", "first")
    open_ = named.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 != c2").select("key")
    named = scratch.write(named.join(open_, "key").join(small.drop("wide"), "id"), "open")
    scratch.drop("named")
    a, b = (named.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "component", "n", "sketch")]) for side in "ab")
    more = a.join(b, "key").filter("a_id < b_id and a_component != b_component").filter(allowed("a", "b", params)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    more = scratch.write(more.join(stars, ["a", "b"], "left_anti"), "more")
    late = verified(docs, sifted(more), scratch, "more", params)
    scratch.drop("open", "stars", "more", "own")
    final = scratch.write(components(links.union(late), scratch, "last"), "last")
    named = member.filter("set_id is not null").join(final, F.col("set_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "set_id").alias("component_id"))
    return named.unionByName(member.filter("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """The rows of ``docs`` without those whose group has a smaller doc_id; of repeated rows of one doc_id all stay."""
    gone = fresh(docs, "gone_doc_id")
    ids = ngram_groups(docs, params).filter("doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")
