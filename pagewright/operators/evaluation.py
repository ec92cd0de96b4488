"""Evaluation: character errors, numbers, table controls, recall, report. What isn't measured is null, never 0."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RANKS
from ..functions.distance import edit_distance
from ..functions.text import first_accepted, fractions, layout_normalised, mark, number_normalised, number_tokens, percent_label
from ..session import with_code
from .blocks import spread

#: Up to so many questions travel to all executors.
SMALL = 100_000
#: Words of the shingle by which a question finds the texts that may hold it.
SHINGLE = 5


def cer(pairs: DataFrame) -> DataFrame:
    """reference, hypothesis: edit distance over the length of the reference, layout aside; an empty reference gives null."""
    rows = pairs.withColumns({"ref_": layout_normalised(F.col("reference")), "hyp_": layout_normalised(F.col("hypothesis"))})
    with_code(pairs.sparkSession)
    rows = rows.withColumns({"distance": edit_distance(F.col("ref_"), F.col("hyp_")), "length": F.char_length("ref_")}).drop("ref_", "hyp_")
    return rows.withColumn("cer", F.try_divide(F.col("distance").cast("double"), F.col("length").cast("double")))


def weighted_cer(measured: DataFrame, *keys: str) -> DataFrame:
    """Errors over characters, for all pages or by key."""
    return measured.groupBy(*keys).agg(F.try_divide(F.sum("distance").cast("double"), F.sum("length").cast("double")).alias("cer"), F.sum("length").alias("characters"), F.count(F.lit(1)).alias("pages"))


def number_counts(pages: DataFrame, text: str = "text") -> DataFrame:
    """page_id, token, n: the multiset of numbers of each page."""
    return pages.select("page_id", F.explode(number_tokens(F.col(text))).alias("token")).groupBy("page_id", "token").agg(F.count(F.lit(1)).alias("n"))


def number_accuracy(pairs: DataFrame) -> DataFrame:
    """page_id, expected, read, correct: sizes of the two multisets and of what they share."""
    want = number_counts(pairs.select("page_id", F.col("reference").alias("text"))).withColumnRenamed("n", "want")
    have = number_counts(pairs.select("page_id", F.col("hypothesis").alias("text"))).withColumnRenamed("n", "have")
    both = want.join(have, ["page_id", "token"], "full_outer").groupBy("page_id").agg(
        F.coalesce(F.sum("want"), F.lit(0)).alias("expected"), F.coalesce(F.sum("have"), F.lit(0)).alias("read"), F.coalesce(F.sum(F.when(F.col("want").isNotNull() & F.col("have").isNotNull(), F.least("want", "have"))), F.lit(0)).alias("correct")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "read", "correct")]
    return pairs.select("page_id").distinct().join(both, "page_id", "left").select("page_id", *zero)


def number_rates(accuracy: DataFrame, *keys: str) -> DataFrame:
    total = accuracy.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("expected", "read", "correct")])
    return total.withColumns({"recall": F.try_divide(F.col("correct").cast("double"), F.col("expected").cast("double")), "precision": F.try_divide(F.col("correct").cast("double"), F.col("read").cast("double"))})


def consumed(expected: DataFrame, available: DataFrame) -> DataFrame:
    """Expected numbers (control, page_id, position, value) matched one by one against a page's multiset."""
    rows = expected.withColumn("token", number_normalised(F.col("value")))
    w = Window.partitionBy("control", "page_id", "token").orderBy("position")
    rows = rows.withColumn("nth", F.row_number().over(w)).join(available, ["page_id", "token"], "left")
    return rows.withColumn("found", F.col("nth") <= F.coalesce("n", F.lit(0))).select("control", "page_id", "position", "value", "found")


def expected_number_controls(expected: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a control: found and missing values in declared order; a missing page misses everything."""
    rows = consumed(expected, number_counts(pages)).join(pages.select("page_id", F.lit(True).alias("there")), "page_id", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("position", "value"))))
    missing = F.array_sort(F.collect_list(F.when(~F.col("found"), F.struct("position", "value"))))
    if "declared_at" in expected.columns:
        order = expected.groupBy("control", "page_id").agg(F.min("declared_at").alias("declared_at"))
        return expected_number_controls(expected.drop("declared_at"), pages).join(order, ["control", "page_id"])
    out = rows.groupBy("control", "page_id").agg(found.alias("f"), missing.alias("m"), (~F.coalesce(F.bool_or("there"), F.lit(False))).alias("page_missing"))
    return out.select("control", "page_id", F.transform("f", lambda x: x["value"]).alias("found"), F.transform("m", lambda x: x["value"]).alias("missing"), "page_missing", (~F.col("page_missing") & (F.size("m") == 0)).alias("passed"))


def fraction_values(pages: DataFrame, controls: DataFrame) -> DataFrame:
    """control, denominator, page_number, position, value for controls (control, first_page, last_page, denominator)."""
    rows = pages.join(controls, F.col("page_number").between(F.col("first_page"), F.col("last_page")))  # controls are a few, declared
    return rows.select("control", "denominator", "page_number", F.posexplode(fractions(F.col("text"), F.col("denominator"))).alias("position", "value"))


def segments(values: DataFrame) -> DataFrame:
    """control, segment (from 0), lots, total, closed: a value equal to the denominator closes a segment.

    An empty closed segment counts; what is left open at the end does only if it has a value.
    """
    w = Window.partitionBy("control").orderBy("page_number", "position")
    closes = F.when(F.col("value") == F.col("denominator"), 1).otherwise(0)
    rows = values.withColumns({"closes": closes}).withColumn("segment", F.coalesce(F.sum("closes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.groupBy("control", "segment").agg(F.count_if(F.col("closes") == 0).alias("lots"), F.coalesce(F.sum(F.when(F.col("closes") == 0, F.col("value"))), F.lit(0)).alias("total"), (F.max("closes") == 1).alias("closed"))


def table_controls(pages: DataFrame, controls: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared tables (control, segment, name, lots, total) against the segments read; missing pages make them unverifiable."""
    read = segments(fraction_values(pages, controls)).withColumnsRenamed({"lots": "lots_read", "total": "total_read"})
    wanted = controls.select("control", F.explode(F.sequence("first_page", "last_page")).alias("page_number"))
    missing = wanted.join(pages, "page_number", "left_anti").groupBy("control").agg(F.array_sort(F.collect_list("page_number")).alias("missing_pages"))
    rows = declared.join(read, ["control", "segment"], "left").join(missing, "control", "left")
    rows = rows.withColumns({"lots_read": F.coalesce("lots_read", F.lit(0)), "total_read": F.coalesce("total_read", F.lit(0)), "closed": F.coalesce("closed", F.lit(False)), "missing_pages": F.coalesce("missing_pages", F.array().cast("array<int>"))})
    return rows.withColumn("passed", (F.size("missing_pages") == 0) & F.col("closed") & (F.col("lots_read") == F.col("lots")) & (F.col("total_read") == F.col("total")))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingles(tokens: Column, width: int) -> Column:
    """Of some words in a row: their hash, and how many letters they have."""
    at = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - width + 1)).otherwise(F.array().cast("array<int>"))
    joined = F.transform(at, lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.transform(joined, lambda s: F.struct(F.char_length(s).alias("letters"), F.xxhash64(s).alias("key")))


def containing(texts: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, page_id for every text (page_id, text) that holds a question (query_id, question) letter by letter.

    Whatever stands between two white spaces of a question is whole words of a text that holds it. So a question is looked up
    by a run of up to five of those words; then the texts that have it are compared. Questions without such words, of one or
    two words, are compared with every text. A batch of questions goes to all tasks, and texts are compared where they are read; a larger
    one meets the texts' runs by hash.
    """
    some = questions.select("query_id", "question").filter(F.col("question").isNotNull()).limit(SMALL + 1).toPandas()
    if len(some) > SMALL:
        return _containing_many(texts, questions)
    with_code(texts.sparkSession)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((questions, "query_id"), (texts, "page_id"))]
    dealt = spread(texts.select("page_id", "text"), "page_id").filter(F.col("text").isNotNull())
    return dealt.mapInPandas(_holders(list(zip(some["query_id"], some["question"]))), "query_id {}, page_id {}".format(*kinds))


def _runs(words: list[str], width: int):
    return zip(*(words[i:] for i in range(width)))


def _holders(questions: list[tuple[object, str]]):
    """Batches of (page_id, text) to (query_id, page_id), for a batch of questions (query_id, question)."""
    by_width: dict[int, dict[tuple, list[int]]] = {}
    for k, (_, question) in enumerate(questions):
        inner = question.split()[1:-1]
        width = min(len(inner), SHINGLE)
        run = max(_runs(inner, width), key=lambda r: sum(map(len, r))) if width else ()
        by_width.setdefault(width, {}).setdefault(run, []).append(k)

    def run(batches):
        for batch in batches:
            out = []
            for page, text in zip(batch["page_id"], batch["text"]):
                words = text.split()
                for width, keys in by_width.items():
                    for key in keys.keys() & set(_runs(words, width)) if width else keys:
                        out += [(questions[k][0], page) for k in keys[key] if questions[k][1] in text]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "page_id"])

    return run


def _containing_many(texts: DataFrame, questions: DataFrame) -> DataFrame:
    asked = questions.select("query_id", "question", _tokens(F.col("question")).alias("t"))
    inner = F.slice("t", F.lit(2), F.greatest(F.size("t") - 2, F.lit(0)))
    asked = asked.select("query_id", "question", inner.alias("t")).withColumn("width", F.least(F.size("t"), F.lit(SHINGLE)))
    words, found = texts.select("page_id", _tokens(F.col("text")).alias("t")), []
    for (width,) in asked.select("width").distinct().collect():  # 0 to SHINGLE
        own = asked.filter(F.col("width") == width)
        small = own.limit(SMALL + 1).count() <= SMALL
        if not width:
            short = own.select("query_id", "question")
            pairs = texts.select("page_id", "text").join(F.broadcast(short) if small else short, F.contains("text", "question")).select("query_id", "page_id")
        else:
            keys = own.select("query_id", "question", F.array_max(_shingles(F.col("t"), width)).alias("s")).select("query_id", "question", F.col("s.key").alias("key"))
            has = words.select("page_id", F.explode(F.array_distinct(F.transform(_shingles(F.col("t"), width), lambda s: s["key"]))).alias("key"))
            may = has.join(F.broadcast(keys) if small else keys, "key").select("query_id", "question", "page_id").distinct()
            pairs = texts.select("page_id", "text").join(may, "page_id").filter(F.contains("text", "question")).select("query_id", "page_id")
        found.append(pairs)
    return reduce(DataFrame.unionByName, found) if found else questions.select("query_id").limit(0).join(texts.select("page_id").limit(0))


def first_expected_rank(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, rank of the first hit on an expected page (questions: query_id, pages), or null."""
    rows = questions.select("query_id", "pages").join(hits.select("query_id", "rank", "page_number"), "query_id", "left")
    return rows.groupBy("query_id").agg(F.min(F.when(F.array_contains("pages", F.col("page_number")), F.col("rank"))).alias("rank"))


def recall_at(ranks: DataFrame, at: tuple[int, ...] = RANKS) -> DataFrame:
    """k, recall: the share of questions with a rank up to k; no question is an error."""
    none = F.count(F.lit(1)) == 0
    totals = ranks.agg(*[F.when(none, F.raise_error(F.lit("recall over no question")).cast("double")).otherwise(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))).alias(f"r{k}") for k in at])
    return totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in at])).alias("x")).select("x.k", "x.recall")


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: each one-row aggregate as a struct, and all of it as JSON."""
    rows = [df.agg(F.first(F.struct(*df.columns)).alias(name)) for name, df in parts.items()]
    joined = reduce(lambda a, b: a.join(b), rows)  # one row each
    return joined.withColumn("json", F.to_json(F.struct(*parts)))


def report_markdown(rows: DataFrame, title: str) -> str:
    """A table of measure, value (share or null) and passed, rendered."""
    lines = rows.select("measure", percent_label(F.col("value")).alias("value"), mark(F.coalesce("passed", F.lit(False))).alias("mark"), "passed").collect()
    body = [f"| {r['measure']} | {r['value']} | {r['mark'] if r['passed'] is not None else ''} |" for r in lines]
    return "\n".join([f"# {title}", "", "| mesure | valeur | |", "|---|---|---|", *body, ""])


def exact_answers(results: DataFrame) -> DataFrame:
    """One row: the share of answered questions (answer) in whose answer an accepted value (found) stands; null without any."""
    answered = F.when(F.col("answer").isNotNull(), F.col("found").isNotNull().cast("double"))
    return results.agg(F.avg(answered).alias("exact_answers"))


def question_results(questions: DataFrame, ranks: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, rank, answer, found: the first accepted value that a question's answer holds, beside its rank.

    ``questions``: query_id, values; ``ranks`` as first_expected_rank gives them; ``answers``: query_id, answer (null: not asked).
    """
    rows = questions.select("query_id", "values").join(ranks, "query_id", "left").join(answers.select("query_id", "answer"), "query_id", "left")
    return rows.select("query_id", "rank", "answer", F.when(F.col("answer").isNotNull(), first_accepted(F.col("answer"), F.col("values"))).alias("found"))
