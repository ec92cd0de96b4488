"""Quality rules: per-text digests and cross-document line frequency, in DataFrame functions only.

Base rules come from the text alone: too few words, or too many words inside repeated three-word windows.
The method proper hashes every normalised line, counts in how many distinct documents of one host (``source``) it
stands, takes away the lines above the host's limit (a share of its documents, between a floor and a ceiling), and
rejects documents of which too little is left. The document that carries a line first (the smallest doc_id) isn't
charged for it and keeps it, and so do exact copies of that document, so that a copied document isn't taken for
boilerplate (copies are the joins' business). ``quality_filter`` returns the texts without the lines that are charged;
n_chars (where there is one of a whole-number type) follows the text.

Defined results: null text is an empty text (0 words, fails the base rules); a null source is a host of its own;
repeated rows give repeated result rows and count as one document; a null doc_id is an id like others where documents
are counted, its rows are never charged; an empty table gives an empty result; columns other than doc_id, text and
source are neither read nor returned. A window's hash leaves its low bits to the window's number (64 - log2(n) bits
are compared), so in a text of about a million words n_repeat_words may count a chance match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, fresh, texts


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line in more documents of one host than its limit is boilerplate: this share of the host's documents,
    #: at least ``min_docs_per_host`` and at most ``max_docs_per_host``.
    host_share: float = 0.02
    min_docs_per_host: int = 20
    max_docs_per_host: int = 100
    #: A document is depleted when less than this share of its line characters is left.
    min_left: float = 0.5


#: A line with a word, and its hash: letters in lower case, digits alike, without white space and common marks.
HAS_WORD = r"l rlike '[^\\x20\\x09-\\x0D]'"
LINE_HASH = "xxhash64(translate(lower(l), '0123456789 \t\r.,;:!?', '0000000000'))"


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the counts of the base rules and the hashes of the lines."""
    base = texts(docs, F.coalesce(F.col("source"), F.lit("\0")).alias("host")).withColumn("words", F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), ""))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    # Three-word windows: as many hash bits as the window's number leaves free, the number below them.
    base = base.withColumn("bits", F.expr("cast(ceil(log2(n_words + 2)) as int)")).withColumn(
        "windows",
        F.expr("sort_array(transform(slice(words, 1, cast(greatest(n_words - 2, 0) as int)), (w, i) -> shiftleft(xxhash64(w, get(words, i + 1), get(words, i + 2)), bits) | cast(i as bigint)))"),
    )
    base = base.withColumn("same", F.expr("filter(windows, (x, k) -> coalesce(shiftright(x, bits) = shiftright(get(windows, k - 1), bits), false) or coalesce(shiftright(x, bits) = shiftright(get(windows, k + 1), bits), false))"))
    base = base.withColumn("starts", F.expr("transform(same, x -> x & (shiftleft(1L, bits) - 1))"))
    base = base.withColumn("lines", F.expr(rf"filter(split(text, '\n'), l -> {HAS_WORD})"))
    return base.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        "n_words",
        F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(flatten(array(starts, transform(starts, x -> x + 1), transform(starts, x -> x + 2))))) as bigint)").alias("n_repeat_words"),
        F.expr(f"transform(lines, l -> struct({LINE_HASH} as hash, char_length(l) as chars))").alias("lines"),
    )


def frequent_lines(rows: DataFrame, params: QualityParams) -> DataFrame:
    """host, hash and the first document's text (by hash) of the lines above the limit of their host."""
    lines = rows.select("host", "text_hash", "doc_id", F.explode(F.array_distinct("lines.hash")).alias("hash"))
    # A row for each line and document first, so that a line in a third of all rows is summed on the map side.
    by_doc = lines.groupBy("host", "hash", "doc_id").agg(F.min("text_hash").alias("text_hash"))
    # Nothing below the floor meets the hosts' sizes: few rows of all, one host's included.
    counted = by_doc.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "text_hash")).alias("first")).filter(F.col("n_docs") > min(params.min_docs_per_host, params.max_docs_per_host))
    hosts = rows.select("host", "doc_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    limit = F.least(F.lit(float(params.max_docs_per_host)), F.greatest(F.lit(float(params.min_docs_per_host)), params.host_share * F.col("host_docs")))
    return counted.join(hosts, "host").filter(F.col("n_docs") > limit).select("host", "hash", F.col("first.text_hash").alias("first_text"))


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The digests with ``base_failed``, ``left_share`` and the verdict ``kept``, one row per row of ``docs``."""
    rows = Scratch(docs.sparkSession, "quality").write(digests(docs), "digests")
    return judged(rows, frequent_lines(rows, params), params)


def judged(rows: DataFrame, frequent: DataFrame, params: QualityParams) -> DataFrame:
    charged = (
        rows.select("host", "doc_id", "text_hash", F.explode("lines").alias("line"))
        .select("host", "doc_id", "text_hash", F.col("line.hash").alias("hash"), F.col("line.chars").alias("chars"))
        .join(frequent, ["host", "hash"])
        .filter(F.col("doc_id").isNotNull() & (F.col("text_hash") != F.col("first_text")))
        .groupBy("doc_id")
        .agg(F.sum("chars").alias("gone"))
    )
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    copies = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    out = rows.withColumn("total", total).join(charged.join(copies, "doc_id", "left").select("doc_id", (F.col("gone") / F.coalesce("rows", F.lit(1))).alias("gone")), "doc_id", "left")
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    left = F.when(F.col("total") > 0, 1 - F.coalesce("gone", F.lit(0.0)) / F.col("total")).otherwise(1.0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), left.alias("left_share"), (~failed & (left >= params.min_left)).alias("kept"))


def quality_filter(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; the texts without the lines that are charged."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(digests(docs), "digests")
    frequent = scratch.write(frequent_lines(rows, params), "frequent")
    verdicts = scratch.write(judged(rows, frequent, params).filter(~F.col("kept")).select("doc_id").distinct(), "rejected")
    lines = rows.select("host", "doc_id", "text_hash", F.explode("lines.hash").alias("hash")).join(frequent, ["host", "hash"]).filter(F.col("doc_id").isNotNull() & (F.col("text_hash") != F.col("first_text")))
    ids, hosts, hashes = (fresh(docs, c) for c in ("gone_doc_id", "gone_host", "gone_hashes"))
    gone = scratch.write(lines.groupBy(F.col("doc_id").alias(ids), F.col("host").alias(hosts)).agg(F.collect_set("hash").alias(hashes)), "gone")
    scratch.drop("digests", "frequent")
    kept = docs.join(verdicts.withColumnRenamed("doc_id", ids), F.col("doc_id").eqNullSafe(F.col(ids)), "left_anti")
    joined = kept.join(gone, (F.col("doc_id") == F.col(ids)) & (F.coalesce("source", F.lit("\0")) == F.col(hosts)), "left")
    left = F.expr(rf"array_join(filter(split(text, '\n'), l -> not ({HAS_WORD} and array_contains({hashes}, {LINE_HASH}))), '\n')")
    out = {"text": F.when(F.col(hashes).isNotNull(), left).otherwise(F.col("text"))}
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        out["n_chars"] = F.when(F.col(hashes).isNotNull(), F.char_length(left)).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return joined.withColumns(out).select(*docs.columns)
