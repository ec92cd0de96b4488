"""Text columns: white space, keys, numbers, fractions, labels. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CUT_MARK, IMAGE_SUFFIXES

# Patterns of the text operators.
NUMBER_TOKEN = r"[0-9I](?:[0-9IO]|[.,/](?=[0-9IO])|[ \u00a0\u202f](?=[0-9IO]{3}(?![0-9IO])))*"
FRACTION = r"(?<![0-9IO])([0-9IO](?:[0-9IO]|[.,](?=[0-9IO]))*)\s*/\s*([0-9IO](?:[\s.,]?[0-9IO]){3})(?![0-9IO])"
TABLE_SEPARATOR = r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$"


#: What ``(?U)\\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: How a row begins whose first cell names a total; a cell after its pipe, without white space around it; one that is a number, in a row without white space.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOTAL_LABEL = rf"(?i)^[{_SPACES}]*+\|?[{_SPACES}]*+(?:total|somme|montant total)"
CELL = rf"\|[{_SPACES}]*+([^|]*[^|{_SPACES}])?"
NUMBER_CELL = r"\|([-+]?[0-9]++(?:[.,][0-9]++)*+)(?=\||\z)"


def ustrip(text: Column) -> Column:
    """Strip all Unicode white space, which trim() doesn't."""
    return F.btrim(text, F.lit(WHITE))


def indent(text: Column) -> Column:
    """How many code points of white space a text begins with."""
    return F.char_length(text) - F.char_length(F.ltrim(text, F.lit(WHITE)))


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def chunk_id(document_id: Column, page_number: Column) -> Column:
    """A key from the position, never from the content, so that indexing anew overwrites."""
    return F.concat_ws(":", document_id.cast("string"), page_number.cast("string"))


def image_path(stage: str, document_id: Column, page_number: Column, suffix: Column) -> Column:
    return F.format_string("%s/%s/%04d%s", F.lit(stage), document_id.cast("string"), page_number.cast("int"), suffix)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return suffix_of(path).isin(*IMAGE_SUFFIXES)


def natural_key(name: Column) -> Column:
    """A string that sorts page2 before page10, whatever the case: digit runs are padded to equal width."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "\x01")


def layout_normalised(text: Column) -> Column:
    """Join hyphenated words, drop filler dashes, one space everywhere."""
    text = F.regexp_replace(text, r"(?U)(\w)-[ \t]*\n\s*(\w)", "$1$2")
    return ustrip(one_space(F.regexp_replace(text, r"-{2,}", " ")))


def number_normalised(token: Column) -> Column:
    return F.regexp_replace(F.translate(token, "IO", "10"), r"[. \u00a0\u202f]", "")


def number_tokens(text: Column) -> Column:
    """The normalised numbers of a text; a token needs one real digit."""
    found = F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), 0)
    return F.transform(F.filter(found, lambda t: t.rlike("[0-9]")), number_normalised)


def _whole(token: Column) -> Column:
    return F.replace(number_normalised(F.regexp_replace(token, r"\s", "")), F.lit(","), F.lit("")).cast("bigint")


def fractions(text: Column, denominator: Column) -> Column:
    """Numerators of n/denominator in the order of the text."""
    tops = F.regexp_extract_all(text, F.lit(FRACTION), 1)
    bottoms = F.regexp_extract_all(text, F.lit(FRACTION), 2)
    pairs = F.zip_with(tops, bottoms, lambda t, b: F.struct(_whole(t).alias("n"), _whole(b).alias("d")))
    return F.transform(F.filter(pairs, lambda p: p["d"] == denominator), lambda p: p["n"])


def parse_number(text: Column) -> Column:
    """A cell that is nothing but a number, as decimal(18,6); null otherwise.

    Currency signs and white space go. With both separators the last is the decimal one; a lone comma is decimal;
    several points part thousands.
    """
    return F.get(parse_numbers(F.array(text)), F.lit(0))


def parse_numbers(texts: Column) -> Column:
    """The same for the cells of an array. What is used more than once is an array of its own: a lambda computes what it is given once."""
    bare = F.transform(texts, lambda t: F.translate(t, "€$£%" + WHITE, ""))
    return F.transform(bare, lambda b: F.when(b.rlike(r"^[-+]?[0-9]+([.,][0-9]+)*$"), _decimal(b).try_cast("decimal(18,6)")))


def cell_numbers(row: Column) -> Column:
    """The numbers of a table's row in order: what ``parse_number`` gives for each of its cells, where that isn't null."""
    bare = F.concat(F.lit("|"), F.translate(row, "€$£%" + WHITE, ""))
    found = F.regexp_extract_all(bare, F.lit(NUMBER_CELL), F.lit(1))
    return F.array_compact(F.transform(found, lambda b: _decimal(b).try_cast("decimal(18,6)")))


def _decimal(bare: Column) -> Column:
    both = bare.contains(",") & bare.contains(".")
    last_is_comma = F.length(F.substring_index(bare, ",", -1)) < F.length(F.substring_index(bare, ".", -1))
    tail = F.when(last_is_comma, F.substring_index(bare, ",", -1)).otherwise(F.substring_index(bare, ".", -1))
    head = F.translate(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail) - 1), ".,", "")
    dotted = F.replace(bare, F.lit(","), F.lit("."))
    many = F.length(dotted) - F.length(F.translate(dotted, ".", "")) > 1
    return F.when(both, F.concat(head, F.lit("."), tail)).when(many, F.translate(dotted, ".", "")).otherwise(dotted)


def amounts_match(expected: Column, actual: Column) -> Column:
    """Within two hundredths, or half a percent of the expected amount."""
    gap = F.abs(expected - actual)
    return (gap <= F.lit("0.02").cast("decimal(18,6)")) | ((expected != 0) & (gap * 1000 <= F.abs(expected) * 5))


def answer_normalised(text: Column) -> Column:
    return one_space(F.regexp_replace(F.lower(text), r"(?<=[0-9])[ .\u00a0\u202f](?=[0-9])", ""))


def first_accepted(answer: Column, values: Column) -> Column:
    """The first accepted value that the answer holds, in the declared order."""
    text = answer_normalised(answer)
    return F.get(F.filter(values, lambda v: text.contains(answer_normalised(v))), F.lit(0))


def unfenced(text: Column) -> Column:
    """What stands in a code fence that wraps the whole text; the text itself if it has a fence inside."""
    inner = F.regexp_extract(ustrip(text), r"(?s)^```[\w-]*[ \t]*\n(.*?)\n?```$", 1)
    wrapped = ustrip(text).rlike(r"(?s)^```[\w-]*[ \t]*\n.*```$") & ~inner.contains("```")
    return F.when(wrapped, inner).otherwise(ustrip(text))


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def score_label(score: Column) -> Column:
    """Two decimals with a comma, a dash for what wasn't measured."""
    return F.when(score.isNull(), "—").otherwise(F.translate(F.format_string("%.2f", score), ".", ","))


def percent_label(share: Column) -> Column:
    return F.when(share.isNull(), "non mesuré").otherwise(F.format_string("%.1f%%", share * 100))


def mark(passed: Column) -> Column:
    return F.when(passed, "✓").otherwise("✗")


def widget_key(prefix: str, ids: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.array_join(ids, "\n"), 256), 1, 12))


def select_index(options: Column, wanted: Column) -> Column:
    """Where a wanted id stands in a list, 0 if it is gone."""
    return F.greatest(F.array_position(options, wanted) - 1, F.lit(0))


def prompt_budget(context_tokens: int, answer_tokens: int, chars_per_token: float = 1.8) -> int:
    return int((context_tokens - answer_tokens) * chars_per_token)


def context_budget(prompt_chars: int, rules: str, question: Column) -> Column:
    """What the prompt leaves for passages beside rules, question and the blank lines between; no room is an error."""
    left = F.lit(prompt_chars - len(rules) - 4) - F.char_length(question)
    return F.when(left > 0, left).otherwise(F.raise_error(F.lit("the question leaves no room for a passage")).cast("int"))


def cut_passage(passage: Column, max_chars: int | Column) -> Column:
    """The best passage cut to fit, the cut written out; whole where there is no room for the mark."""
    room = (F.lit(max_chars) if isinstance(max_chars, int) else max_chars) - len(CUT_MARK)
    return F.when(room >= 0, F.concat(F.substring(passage, F.lit(1), room), F.lit(CUT_MARK))).otherwise(passage)


def document_label(filename: Column, pages: Column, progress: Column, created_at: Column, document_id: Column) -> Column:
    """How a list names a document: file, pages, progress, when it came, the beginning of its id."""
    about = F.concat_ws(" — ", filename, F.concat(pages.cast("string"), F.lit(" p.")), progress, F.date_format(created_at, "yyyy-MM-dd HH:mm"))
    return F.concat_ws(" · ", about, F.substring(document_id.cast("string"), 1, 8))


def transcription_timeout(model_seconds: float, pages: int = 200, passes: int = 2) -> float:
    """How long a batch may take: each page of the largest one in two passes, at the model's own limit."""
    return pages * passes * model_seconds


def bm25_idf(df: Column, n: Column) -> Column:
    """The weight of a term that ``df`` of ``n`` passages have."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_share(idf: Column, tf: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """One term's share of a passage's BM25 score."""
    return idf * tf / (tf + k1 * (1 - b + b * length / average))


def match_offsets(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of all matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.char_length(x["g"])
        end = begin + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("match")))).alias("spans"))

    return F.aggregate(pairs, start, step, lambda a: a["spans"])
