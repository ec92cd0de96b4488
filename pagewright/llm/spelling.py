"""Spelling variants: words one letter apart, found by rolling-hash deletion keys.

A word's deletion keys are the hashes of what is left of it without one letter, and its own. Prefix and suffix sums of
a polynomial hash give all of a word's keys at once, in numpy, without building a string. The keys are dealt out by
their leading bits and sorted; words that meet under one key are candidates, and the strings decide. Two words of equal
length are near when they leave the same string by a deletion at the same place; two of unlike length when a deletion of
the longer one is the shorter one. So words meet in groups of at most one member a letter of the alphabet, and near words are
counted by group instead of pair by pair.

Keys carry the word's number alone, not the word, so a word of L letters makes L + 1 short rows however long it is.

Defined results: null or empty texts have no words; a null doc_id counts as an empty string in the damage; rows that
are repeated count each; an empty table gives an empty result; columns other than doc_id and text are neither read nor
returned. Ties between forms go by code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, texts

# The letters of a word, and the share of (document, word) pairs that lose a letter.
RUN = r"[A-Za-zÀ-ÿ]+"
DAMAGED_OF = 97


@dataclass(frozen=True)
class SpellingParams:
    min_length: int = 5
    min_count: int = 3
    #: A word's form is at least so many times as frequent.
    ratio: int = 2


#: Base of the polynomial (odd, so that it has an inverse modulo 2^64), and cells of one block of letters.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CELLS = 1 << 20
KEYS = "key long, id long, pos int, last boolean"
FOUND = "id long, pos int, replaced boolean, shifted boolean"


def words(docs: DataFrame, params: SpellingParams = SpellingParams(), damaged_of: int = DAMAGED_OF) -> DataFrame:
    """word, n: the words of all texts, after the letter that some of them lose in some documents."""
    lower = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), 0)).alias("run"))
    runs = lower.filter(F.char_length("run") >= params.min_length).withColumn("h", F.crc32(F.concat_ws(":", "doc", "run")))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    word = F.when(F.col("h") % damaged_of == 0, less).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.char_length("word") >= params.min_length) & (F.col("n") >= params.min_count))


def mixed(x: np.ndarray) -> np.ndarray:
    """All bits of a hash depend on all others: the leading bits deal the keys out."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own key and the key without letter i, for rows of equally long words (code points)."""
    n = codes.shape[1]
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    terms = (codes.astype(np.uint64) + np.uint64(1)) * power
    prefix = np.cumsum(terms, axis=1, dtype=np.uint64)
    whole = prefix[:, -1:]
    suffix = (whole - prefix) * np.uint64(INVERSE)  # the letters after i, one place further to the front
    length = lambda k: np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64))
    return mixed(whole[:, 0] + length(n)), mixed(prefix - terms + suffix + length(n - 1))


def _keys(batches):
    for batch in batches:
        sizes = batch["word"].str.len().to_numpy()
        for size in np.unique(sizes):
            some = batch[sizes == size]
            step = max(1, CELLS // int(size))
            for k in range(0, len(some), step):
                part = some.iloc[k : k + step]
                codes = np.frombuffer("".join(part["word"]).encode("utf-32-le"), np.uint32).reshape(len(part), size)
                own, without = deletion_keys(codes)
                ids = part["id"].to_numpy()
                yield pd.DataFrame({"key": own.view(np.int64), "id": ids, "pos": np.int32(-1), "last": False})
                last = np.ones(codes.shape, bool)  # of equal letters in a row, deleting any leaves the same
                last[:, :-1] = codes[:, :-1] != codes[:, 1:]
                for a in range(0, size, CELLS):
                    b = min(size, a + CELLS)
                    yield pd.DataFrame({"key": without[:, a:b].ravel().view(np.int64), "id": np.repeat(ids, b - a), "pos": np.tile(np.arange(a, b, dtype=np.int32), len(part)), "last": last[:, a:b].ravel()})


def candidates(key: np.ndarray, pos: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and pos: which share key and place with another, and which meet a whole word's key or are one."""
    new_key = np.r_[True, key[1:] != key[:-1]]
    run = np.cumsum(new_key) - 1
    place = np.cumsum(new_key | np.r_[True, pos[1:] != pos[:-1]]) - 1
    replaced = (pos >= 0) & (np.bincount(place)[place] > 1)
    whole, cut = np.bincount(run, pos < 0) > 0, np.bincount(run, last & (pos >= 0)) > 0
    return replaced, (whole & cut)[run] & ((pos < 0) | last)


def _met(batches):
    """Sorted keys in, candidate rows out; the last key of a batch waits for the next batch."""
    kept = None
    for batch in batches:
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        key = rows["key"].to_numpy()
        if not len(key):
            continue
        end = int(np.searchsorted(key, key[-1]))
        kept, rows = rows.iloc[end:], rows.iloc[:end]
        if end:
            yield _found(rows)
    if kept is not None:
        yield _found(kept)


def _found(rows: pd.DataFrame) -> pd.DataFrame:
    replaced, shifted = candidates(rows["key"].to_numpy(), rows["pos"].to_numpy(), rows["last"].to_numpy())
    out = rows[["id", "pos"]].assign(replaced=replaced, shifted=shifted)
    return out[replaced | shifted]


def near(scratch: Scratch, numbered: DataFrame) -> DataFrame:
    """id, n_near, best (struct of -n and word) of the words (id, word, n) that have a near word."""
    keys = numbered.select("id", "word").mapInPandas(_keys, KEYS)
    # Radix: the leading 16 bits of a key name its partition.
    dealt = keys.repartition(F.shiftright("key", 48)).sortWithinPartitions("key", "pos")
    found = scratch.write(dealt.mapInPandas(_met, FOUND), "candidates")
    rest = F.when(F.col("pos") < 0, F.col("word")).otherwise(F.concat(F.col("word").substr(F.lit(1), F.col("pos")), F.col("word").substr(F.col("pos") + 2, F.char_length("word"))))
    rows = found.join(numbered, "id").withColumn("rest", rest).withColumn("self", F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"), F.col("id").alias("id")))
    # Equal length: all members of a group are near each other; the first one's best is the second one.
    group = rows.filter("replaced").groupBy("rest", "pos").agg(F.array_sort(F.collect_list("self")).alias("own")).filter(F.size("own") > 1)
    equal = group.select(F.size("own").cast("long").alias("k"), "own", F.posexplode("own").alias("i", "one")).select(
        F.col("one.id").alias("id"), (F.col("k") - 1).alias("k"), F.when(F.col("i") == 0, F.col("own")[1]).otherwise(F.col("own")[0]).alias("best")
    )
    # One letter more or less: a deletion that is a word.
    whole = rows.filter("shifted AND pos < 0").select("rest", F.col("self").alias("short"))
    pair = rows.filter("shifted AND pos >= 0").select("rest", F.col("self").alias("long")).join(whole, "rest")
    both = pair.select(F.explode(F.array(F.struct(F.col("short.id").alias("id"), F.col("long").alias("best")), F.struct(F.col("long.id").alias("id"), F.col("short").alias("best")))).alias("x"))
    unlike = both.select("x.id", F.lit(1).cast("long").alias("k"), "x.best")
    return equal.unionByName(unlike).groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """word, root for the words that have a form (word, form): every round doubles the steps that a word has gone.

    A form is at least twice as frequent, so a chain has at most 63 steps, and six rounds reach the end of any.
    """
    links = scratch.write(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links-0")
    for k in range(1, 7):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        went = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        links = scratch.write(went, f"links-{k}")
        scratch.drop(f"links-{k - 1}")
        if links.filter("moved").isEmpty():
            break
    return links.select("word", "root")


def spelling_variants(docs: DataFrame, params: SpellingParams = SpellingParams(), damaged_of: int = DAMAGED_OF) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word with its number of near words, its form and the end of its forms."""
    if params.ratio < 2 or params.min_length < 2:
        raise ValueError("ratio and min_length must be 2 or more")
    scratch = Scratch(docs.sparkSession, "spelling")
    numbered = scratch.write(words(docs, params, damaged_of).withColumn("id", F.monotonically_increasing_id()), "numbered")
    best_n = -F.col("best.less")
    takes = best_n >= params.ratio * F.col("n")
    judged = numbered.join(near(scratch, numbered), "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, best_n).alias("form_n")
    )
    judged = scratch.write(judged, "judged")
    scratch.drop("candidates", "numbered")
    ends = roots(scratch, judged.filter("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
