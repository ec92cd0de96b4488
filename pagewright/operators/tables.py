"""Markdown tables and the confidence checks that need no model, as DataFrame operators.

A page becomes lines with offsets, runs of lines with a pipe become tables, lines become rows of cells; the checks
are aggregates over tables and pages. Offsets are code points in the page's text. Input: page_id, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SCORES
from ..functions.text import CELL, TABLE_SEPARATOR, TOTAL_LABEL, amounts_match, cell_numbers, indent, match_offsets, ustrip


def lines(pages: DataFrame) -> DataFrame:
    """page_id, line (from 0), text, start of every line."""
    parts = F.split("text", "\n", -1)
    offsets = F.aggregate(parts, F.expr("struct(0 as at, cast(array() as array<int>) as starts)"), lambda a, x: F.struct((a["at"] + F.char_length(x) + 1).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
    return pages.select("page_id", F.posexplode(F.arrays_zip(parts.alias("text"), offsets.alias("start"))).alias("line", "x")).select("page_id", "line", F.col("x.text").alias("text"), F.col("x.start").alias("start"))


def _table_lines(pages: DataFrame) -> DataFrame:
    """The lines with a pipe: page_id, line, text, start, the line before, and their table (how many lines without a pipe come first, less one)."""
    rows = pages.filter(F.contains("text", F.lit("|"))).select("page_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    order = Window.partitionBy("page_id").orderBy("line")
    upto, size = order.rowsBetween(Window.unboundedPreceding, 0), F.char_length("text") + 1
    start, table = F.sum(size).over(upto) - size, F.sum(F.when(F.contains("text", F.lit("|")), 0).otherwise(1)).over(upto) - 1
    rows = rows.select("page_id", "line", "text", start.cast("int").alias("start"), table.cast("int").alias("table"), F.lag("text").over(order).alias("before"))
    return rows.filter(F.contains("text", F.lit("|")))


def _cell_texts(text: Column) -> Column:
    """The stripped texts of a row's cells: what stands before the first and after the last pipe is a cell if there is something."""
    found = F.regexp_extract_all(F.concat(F.lit("|"), text), F.lit(CELL), F.lit(1))
    first, last = F.when(F.get(found, F.lit(0)) == "", 1).otherwise(0), F.when(F.element_at(found, -1) == "", 1).otherwise(0)
    return F.slice(found, first + 1, F.greatest(F.size(found) - first - last, F.lit(0)))


def _cells(text: Column, start: Column) -> Column:
    """The same cells as (text, start, end)."""
    parts = F.split(text, "[|]", -1)
    before = lambda i: F.when(i == 0, 0).otherwise(F.char_length(F.call_function("substring_index", text, F.lit("|"), i)) + 1)
    cells = F.transform(parts, lambda p, i: F.struct(ustrip(p).alias("text"), (start + before(i) + indent(p)).alias("start"), i.alias("i")))
    cells = F.filter(cells, lambda c: (c["text"] != "") | ((c["i"] != 0) & (c["i"] != F.size(parts) - 1)))
    return F.transform(cells, lambda c: F.struct(c["text"].alias("text"), c["start"].alias("start"), (c["start"] + F.char_length(c["text"])).alias("end")))


def table_rows(pages: DataFrame) -> DataFrame:
    """A row for each data row of each table: cells (text, start, end), the header's cells, their texts alone, span of the row.

    A table's rows are sorted once. What a check doesn't ask for, as the places of cells, isn't computed.
    """
    own = _table_lines(pages).withColumn("is_separator", F.col("text").rlike(TABLE_SEPARATOR))
    # The first separator, with the line before it if that is one of the table's.
    above = F.when(F.contains("before", F.lit("|")), F.struct(F.col("before").alias("text"), (F.col("start") - F.char_length("before") - 1).alias("start"), _cell_texts(F.col("before")).alias("texts")))
    first = F.min(F.when(F.col("is_separator"), F.struct("line", above.alias("header")))).over(Window.partitionBy("page_id", "table"))
    own = own.select("page_id", "table", "line", "text", "start", "is_separator", first.alias("first"))
    data = own.filter(~F.col("is_separator") & (F.col("first").isNull() | (F.col("line") != F.col("first.line") - 1)))
    begin, head = F.col("start") + indent(F.col("text")), F.col("first.header")
    return data.select(
        "page_id", "table", "line", _cells(F.col("text"), F.col("start")).alias("cells"), F.when(head.isNotNull(), _cells(head["text"], head["start"])).alias("header"),
        F.col("text"), _cell_texts(F.col("text")).alias("texts"), head["texts"].alias("header_texts"), begin.alias("row_start"), (begin + F.char_length(ustrip(F.col("text")))).alias("row_end"),
    )


def with_numbers(rows: DataFrame) -> DataFrame:
    """The rows with the values of their purely numeric cells, in order, and whether three of them multiply."""
    rows = rows.withColumn("numbers", cell_numbers(F.col("text")))
    a, b, c = (F.get("numbers", F.lit(i)) for i in range(3))
    consistent = amounts_match(a * b, c) | amounts_match(a * c, b) | amounts_match(b * c, a)
    rows = rows.withColumns({"is_item": F.size("numbers") == 3})
    rows = rows.withColumn("consistent", F.coalesce(F.col("is_item") & consistent, F.lit(False)))
    title = F.array_join("header_texts", " ")
    announced = F.coalesce(title.rlike("(?i)qt[ée]|quantit|nombre|qty") & title.rlike("(?i)total|montant|somme"), F.lit(False))
    w = Window.partitionBy("page_id", "table")
    return rows.withColumn("item_table", F.bool_or(F.col("is_item")).over(w) & (announced | F.bool_or("consistent").over(w)))


def _block(start, end, score, method: str):
    return F.struct(start.cast("int").alias("start_offset"), end.cast("int").alias("end_offset"), score.alias("score"), F.lit(method).alias("method"))


def _row_block(holds, score, method: str):
    """A block over the row where the condition holds, else null."""
    return F.when(holds, _block(F.col("row_start"), F.col("row_end"), score, method))


def with_totals(numbered: DataFrame) -> DataFrame:
    """The rows with what a total row states, the sum of the page's items, and whether one of the page's totals fits it."""
    page = Window.partitionBy("page_id")
    item = F.col("item_table") & F.col("is_item")
    rows = numbered.withColumn("stated", F.when(F.col("text").rlike(TOTAL_LABEL) & (F.size("numbers") == 1), F.get("numbers", F.lit(0))))
    rows = rows.withColumns({"expected": F.sum(F.when(item, F.get("numbers", F.lit(2)))).over(page).cast("decimal(18,6)"), "items": F.count_if(item).over(page)})
    return rows.withColumn("fits", F.coalesce(F.bool_or(amounts_match(F.col("expected"), F.col("stated"))).over(page), F.lit(False)))


def stated_totals(numbered: DataFrame) -> DataFrame:
    return with_totals(numbered).filter("stated is not null")


def _product():
    """A row of an item table whose quantity and price don't give their total."""
    return _row_block(F.col("item_table") & F.col("is_item") & ~F.col("consistent"), F.lit(SCORES["arithmetic"]), "arithmetic")


def _sum():
    """A total row of a page none of whose totals is the sum of its items, of which there are two at least."""
    return _row_block(F.col("stated").isNotNull() & (F.col("items") >= 2) & ~F.col("fits"), F.lit(SCORES["arithmetic"]), "arithmetic")


def _shape():
    """A row wider or narrower than its header; else one with an empty cell."""
    ragged = F.col("header_texts").isNotNull() & (F.size("header_texts") != F.size("texts"))
    empty = F.array_contains("texts", "")
    return _row_block(ragged | empty, F.when(ragged, SCORES["ragged_row"]).otherwise(SCORES["empty_cell"]), "structural")


def _blocks(rows: DataFrame, *checks) -> DataFrame:
    """All blocks of the checks, in one pass over the rows."""
    return rows.select("page_id", F.explode(F.array_compact(F.array(*checks))).alias("block")).select("page_id", "block.*")


def product_blocks(numbered: DataFrame) -> DataFrame:
    return _blocks(numbered, _product())


def sum_blocks(numbered: DataFrame) -> DataFrame:
    return _blocks(with_totals(numbered), _sum())


def shape_blocks(rows: DataFrame) -> DataFrame:
    return _blocks(rows, _shape())


def pattern_blocks(pages: DataFrame) -> DataFrame:
    """Marks of illegible text, and runs of replacement characters."""
    found = None
    for pattern, kind in ((r"(?i)\[illisible\]", "illegible"), ("�+", "replacement")):
        hits = pages.filter(F.col("text").rlike(pattern)).select("page_id", F.explode(match_offsets(F.col("text"), pattern)).alias("m")).select("page_id", _block(F.col("m.start"), F.col("m.end"), F.lit(SCORES[kind]), "structural").alias("block")).select("page_id", "block.*")
        found = hits if found is None else found.unionByName(hits)
    return found


def analysed_pages(pages: DataFrame) -> DataFrame:
    """All blocks of all checks."""
    return pattern_blocks(pages).unionByName(_blocks(with_totals(with_numbers(table_rows(pages))), _shape(), _product(), _sum()))


def page_blocks(pages: DataFrame) -> DataFrame:
    """One row a page: its blocks in order, and its score (the worst of them, 1 without any)."""
    blocks = analysed_pages(pages).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("start_offset", "method", "end_offset", "score"))).alias("blocks"))
    out = pages.select("page_id").join(blocks, "page_id", "left")
    return out.select("page_id", F.coalesce("blocks", F.expr("cast(array() as array<struct<start_offset:int,method:string,end_offset:int,score:double>>)")).alias("blocks"), F.coalesce(F.array_min(F.transform("blocks", lambda b: b["score"])), F.lit(1.0)).alias("score"))
