"""Line dedup: a log-template tree finds lines that recur across documents; they go from all but the first one.

A line's tokens are its words; tokens that look variable (numbers, hashes, addresses, dates) are masked. The tree has
a fixed depth: token count, then leading tokens, down to a leaf. Lines of a leaf whose tokens agree at four of five
positions or more share a template: in the order of their hashes, a line joins the first template it is like, or
begins one. A leaf with many distinct lines goes through this in rounds with the same outcome. The first lines of the
leaf find their templates, the others are held against those in pieces, and what is like none of them makes the next
round, which takes twice as many first lines.

A template recurs when it stands in enough documents: two for long lines, more for short ones, which recur by chance.
The document with the smallest doc_id keeps its lines of a template, every other loses them. Repeats within one
document aren't this operator's business.

Similarity compares all tokens, by four bytes of their hashes in lines of less than 16 tokens and by two in longer ones.

Defined results: null text stays null and has no lines; lines without a word stay; a document may be left with an
empty text; repeated rows count as one document; an empty table gives an empty result; all columns are kept, n_chars
(where there is one of a whole-number type) follows the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, mapped, texts


@dataclass(frozen=True)
class LineParams:
    #: Leading tokens on the way to a leaf.
    depth: int = 3
    #: Lines of a leaf that one task takes together in the first round.
    max_leaf: int = 256
    #: Lines of the leaves that one group of a task holds, on average.
    bucket_lines: int = 4000
    similarity: float = 0.8
    #: A template of at least long_words tokens recurs from min_documents on, a shorter one from short_documents.
    min_documents: int = 2
    long_words: int = 8
    short_documents: int = 10


# What a variable field of a line looks like.
VARIABLE = re.compile(rb"[0-9]|^[A-Za-z][A-Za-z0-9+.-]*://|@")
HASH = re.compile(rb"^[0-9a-f]{8,}$")


def line_tokens(line: bytes) -> list[bytes]:
    """The words of a line, variable ones masked."""
    return [b"<*>" if VARIABLE.search(t) or HASH.match(t) else t for t in line.split()] if VARIABLE.search(line) else line.split()


LINES = "doc_id long, line int, hash long, n_tokens int, leaf long, sketch binary"


def token_type(n_tokens: int) -> type:
    """What a sketch keeps of a token: in short lines a single chance match would decide."""
    return np.uint32 if n_tokens < 16 else np.uint16


def lines_of(docs: DataFrame, params: LineParams) -> DataFrame:
    """A row for each line with a word: hash, leaf and sketch."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for k, line in enumerate(text.encode().split(b"\n")):
                    tokens = line_tokens(line)
                    n = len(tokens)
                    if n:
                        sketch = np.fromiter(map(digest, tokens), np.uint64, n).astype(token_type(n)).tobytes()
                        leaf = signed(digest(b"%d " % n + b" ".join(tokens[: params.depth])))
                        rows.append((doc_id, k, signed(digest(b" ".join(tokens))), n, leaf, sketch))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])

    return mapped(docs, run, LINES)


#: From this many lines on, lines that may be alike are looked up before they are compared.
LOOKED_UP = 1000


def lookup(table: np.ndarray, params: LineParams):
    """A function that gives the rows which may be like a row. Of one block more than tokens may differ, one is equal."""
    n = table.shape[1]
    may_differ = int(((n - np.arange(1, n + 1)) / n >= params.similarity).sum())
    # All lines of a leaf have their leading tokens in common.
    cuts = np.unique(np.linspace(min(params.depth, n - 1), n, may_differ + 2).astype(int))
    if len(cuts) < may_differ + 2:
        return lambda i: np.arange(len(table))
    blocks = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        keys = np.ascontiguousarray(table[:, low:high])
        key = np.unique(keys.view(np.dtype((np.void, keys.itemsize * keys.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        blocks.append((key, np.argsort(key, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(key))])))
    return lambda i: np.concatenate([order[starts[key[i]] : starts[key[i] + 1]] for key, order, starts in blocks])


def merged_leaf(sketches: list[bytes], n_tokens: int, params: LineParams, first: int | None = None) -> np.ndarray:
    """The template of each line of one leaf: the first line that isn't in one yet begins one and takes what is alike.

    Only the ``first`` lines (all by default) may begin one; lines that are like none of them get -1.
    """
    table = np.frombuffer(b"".join(sketches), token_type(n_tokens)).reshape(len(sketches), n_tokens)
    template, rest = np.full(len(table), -1), np.arange(len(table))
    near = lookup(table, params) if len(table) >= LOOKED_UP else None
    for i in range(len(table) if first is None else first):
        if template[i] < 0:
            at = near(i) if near else rest
            at = at[template[at] < 0]
            template[at[(table[at] == table[i]).mean(axis=1) >= params.similarity]] = i
            rest = rest if near else at
    return template


#: The lines of one leaf are dealt over this many tasks where they meet what is known of their leaf.
LEAF_PIECES = 16


def with_leaf(lines: DataFrame, leaves: DataFrame, how: str = "inner") -> DataFrame:
    """``lines`` with the columns of their leaf. A leaf's row is repeated for each piece, so that a leaf with a third of all lines is no hot key."""
    dealt = lines.withColumn("piece", F.pmod(F.xxhash64("hash"), F.lit(LEAF_PIECES).cast("long")))
    repeated = leaves.withColumn("piece", F.explode(F.expr(f"sequence(0L, {LEAF_PIECES - 1}L)")))
    return dealt.join(repeated.hint("merge"), ["leaf", "piece"], how).drop("piece")


def templates_of(lines: DataFrame, params: LineParams, scratch: Scratch) -> DataFrame:
    """hash, template (a line's hash) for the lines that follow another line's template; others are their own."""
    # Equal lines become one row on the map side, so that a line in a third of all documents is no hot key.
    distinct = scratch.write(lines.groupBy("hash").agg(F.first(F.struct("leaf", "n_tokens", "sketch")).alias("line")).select("hash", "line.*"), "lines")
    shared = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("leaf")
    rest = scratch.write(with_leaf(distinct, shared).select("hash", "leaf", "n_tokens", "sketch"), "rest-0")
    scratch.drop("lines")
    found, at_once, turn = [lines.select("hash", F.col("hash").alias("template")).limit(0)], params.max_leaf, 0
    while not rest.isEmpty():
        large = rest.groupBy("leaf").agg(F.min("hash").cast("double").alias("low"), F.max("hash").cast("double").alias("high"), F.count(F.lit(1)).alias("size")).filter(F.col("size") > at_once)
        # Hashes are evenly spread, so the first lines of a leaf are those below a share of its span.
        is_first = F.col("size").isNull() | (F.col("hash").cast("double") <= F.col("low") + (F.col("high") - F.col("low")) * at_once / F.col("size"))
        pieces = F.ceil(F.col("size") / at_once).cast("long")
        dealt = scratch.write(with_leaf(rest, large, "left").select("hash", "leaf", "n_tokens", "sketch", pieces.alias("pieces"), is_first.alias("is_first")), f"dealt-{turn}")
        scratch.drop(f"rest-{turn}")
        firsts, others = dealt.filter("is_first"), dealt.filter("not is_first")
        found.append(scratch.write(first_templates(firsts, params), f"templates-{turn}"))
        if others.isEmpty():
            scratch.drop(f"dealt-{turn}")
            break
        begun = firsts.filter("pieces is not null").join(found[-1].filter("hash = template").select("hash"), "hash", "left_semi")
        taken = scratch.write(taken_lines(begun, others, params), f"taken-{turn}")
        found.append(taken)
        rest = scratch.write(others.join(taken.select("hash"), "hash", "left_anti").select("hash", "leaf", "n_tokens", "sketch"), f"rest-{turn + 1}")
        scratch.drop(f"dealt-{turn}")
        at_once, turn = 2 * at_once, turn + 1
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.filter("hash != template")


def first_templates(rows: DataFrame, params: LineParams) -> DataFrame:
    """hash, template of all rows, each leaf by itself."""
    # Leaves are many and small: a task's group holds the whole leaves of one bucket, some thousands of lines.
    buckets = max(1, rows.count() // params.bucket_lines)

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["leaf", "hash"], ignore_index=True)
        hashes, leaf, n_tokens, sketches = group["hash"].to_numpy(), group["leaf"].to_numpy(), group["n_tokens"].tolist(), group["sketch"].tolist()
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        parts = [i + merged_leaf(sketches[i:j], n_tokens[i], params) for i, j in zip([0, *cuts], [*cuts, len(leaf)], strict=True)]
        return pd.DataFrame({"hash": hashes, "template": hashes[np.concatenate(parts)]})

    rows = rows.select("hash", "leaf", "n_tokens", "sketch", F.pmod(F.xxhash64("leaf"), F.lit(buckets).cast("long")).alias("bucket"))
    return rows.groupBy("bucket").applyInPandas(merged, "hash long, template long")


def taken_lines(begun: DataFrame, others: DataFrame, params: LineParams) -> DataFrame:
    """hash, template of the ``others`` that are like a line which began a template; every piece of a leaf gets those."""

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["is_first", "hash"], ascending=[False, True], ignore_index=True)
        hashes, first = group["hash"].to_numpy(), int(group["is_first"].sum())
        template = merged_leaf(group["sketch"].tolist(), int(group["n_tokens"].iat[0]), params, first)
        at = first + np.flatnonzero(template[first:] >= 0)
        return pd.DataFrame({"hash": hashes[at], "template": hashes[template[at]]})

    columns = ("hash", "leaf", "n_tokens", "sketch", "is_first")
    both = begun.select(*columns, F.explode(F.expr("sequence(0L, pieces - 1)")).alias("piece")).unionByName(others.select(*columns, F.expr("pmod(xxhash64(hash), pieces)").alias("piece")))
    return both.groupBy("leaf", "piece").applyInPandas(merged, "hash long, template long")


def recurring_lines(docs: DataFrame, params: LineParams = LineParams(), scratch: Scratch | None = None) -> DataFrame:
    """doc_id, line, hash, template of every line that goes."""
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.write(lines_of(docs, params), "doc-lines")
    named = scratch.write(templates_of(lines, params, scratch), "templates")
    in_template = lines.select("hash", "doc_id", "n_tokens").join(named, "hash", "left").groupBy(F.coalesce("template", "hash").alias("template"), "doc_id").agg(F.min("n_tokens").alias("n_tokens"))
    stats = in_template.groupBy("template").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("keeper"), F.min("n_tokens").alias("n_tokens"))
    enough = F.when(F.col("n_tokens") >= params.long_words, params.min_documents).otherwise(params.short_documents)
    recurs = scratch.write(stats.filter(F.col("documents") >= enough).select("template", "keeper"), "recurring")
    # Down to line hashes again, so that one small table meets the lines.
    members = named.join(recurs, "template").select("hash", "template", "keeper").unionByName(recurs.select(F.col("template").alias("hash"), "template", "keeper"))
    members = scratch.write(members, "members")
    return lines.select("doc_id", "line", "hash").join(members.hint("merge"), "hash").filter(F.col("doc_id") != F.col("keeper")).select("doc_id", "line", "hash", "template")


def without_lines(text: pd.Series, lines: pd.Series) -> pd.Series:
    """The texts without the lines of these numbers; null where nothing goes."""
    out = []
    for own, gone in zip(text, lines, strict=True):
        if gone is None:
            out.append(None)
        else:
            gone = set(gone.tolist())
            out.append("\n".join(x for i, x in enumerate(own.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def deduped(docs: DataFrame, params: LineParams = LineParams(), dropped: str | None = None) -> DataFrame:
    """The rows of ``docs`` without the lines that go; a column ``dropped``, if it is named, says how many went."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    gone_id, numbers, left = (fresh(docs, c) for c in ("gone_doc_id", "gone_lines", "left_text"))
    gone = recurring_lines(docs, params, scratch).groupBy(F.col("doc_id").alias(gone_id)).agg(F.collect_set("line").alias(numbers))
    gone = scratch.write(gone, "gone")
    scratch.drop("doc-lines", "templates", "recurring", "members")
    # Texts meet their lists in a sort-merge join at every size, so that small inputs tell how large ones behave.
    joined = docs.join(gone.hint("merge"), F.col("doc_id") == F.col(gone_id), "left")
    shortened = F.pandas_udf(without_lines, "string")(F.when(F.col(numbers).isNotNull(), F.col("text")), numbers)
    joined = joined.withColumn(left, shortened)
    out = {"text": F.coalesce(left, "text")}
    kind = dict(docs.dtypes).get("n_chars")
    if kind in ("int", "bigint"):
        out["n_chars"] = F.when(F.col(left).isNotNull(), F.char_length(left)).otherwise(F.col("n_chars")).cast(kind)
    if dropped:
        out[dropped] = F.coalesce(F.size(numbers), F.lit(0))
    return joined.withColumns(out).select(*docs.columns, *([dropped] if dropped else []))


def line_dedup(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """doc_id, the text that is left, and how many lines went."""
    return deduped(texts(docs), params, "n_dropped")


def line_filter(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """The rows of ``docs`` without the lines that go; a document of which nothing is left goes with its lines."""
    dropped = fresh(docs, "n_dropped")
    out = deduped(docs, params, dropped)
    emptied = (F.col(dropped) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(F.col("text").isNull() | ~emptied).drop(dropped)
