"""From text to index terms: words, and for French elisions, stop words and a light stemmer, all as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# French stop words and elisions of the published analyzer (the short function words).
ELISIONS = r"^(?:l|m|t|qu|n|s|j|d|c|jusqu|quoiqu|lorsqu|puisqu)['’]"
STOP_WORDS = tuple("au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y".split())

# Fixed values of the stemmer: plurals, then the first derivation that fits, each with the letters that must stand before it.
PLURALS = ((r"^(.{2,}[^e])aux$", "$1al"), (r"^(.{3,})[xs]$", "$1"))
DERIVATIONS = (
    (r"^(.{2,})issements?$", "$1ir"),
    (r"^(.{3,})issant$", "$1ir"),
    (r"^(.{3,})ativement$", "$1atif"),
    (r"^(.{2,})ivement$", "$1if"),
    (r"^(.{2,})ement$", "$1e"),
    (r"^(.{3,})ment$", "$1"),
    (r"^(.{2,})(?:a|i)bilité$", "$1able"),
    (r"^(.{2,})ivité$", "$1if"),
    (r"^(.{2,})icité$", "$1ique"),
    (r"^(.{3,})ité$", "$1"),
    (r"^(.{2,})atrice$", "$1ateur"),
    (r"^(.{2,})trice$", "$1teur"),
    (r"^(.{3,})euse$", "$1eur"),
    (r"^(.{2,})ive$", "$1if"),
    (r"^(.{2,})(?:isation|isateur)$", "$1ise"),
    (r"^(.{3,})(?:ation|ateur)$", "$1"),
    (r"^(.{3,})(?:elle|el)$", "$1el"),
    (r"^(.{3,})(?:ière|ier)$", "$1ier"),
    (r"^(.{3,})(?:enne|en)$", "$1en"),
)
ACCENTS = ("àâäéèêëîïôöùûüçœ", "aaaeeeeiioouuuco")


def stemmed(word: Column) -> Column:
    """A light stem of a French word in lower case: number, gender and the common derivations go, words of up to four letters stay.

    In this order: plural, one derivation, accents, doubled letters, a final e (with the r or i before it).
    """
    one = reduce(lambda w, rule: w.when(word.rlike(rule[0]), F.regexp_replace(word, *rule)), PLURALS, F.when(F.lit(False), word)).otherwise(word)
    two = reduce(lambda w, rule: w.when(one.rlike(rule[0]), F.regexp_replace(one, *rule)), DERIVATIONS, F.when(F.lit(False), one)).otherwise(one)
    bare = F.regexp_replace(F.translate(two, *ACCENTS), r"(\p{L})\1", "$1")
    return F.when(F.char_length(word) <= 4, word).otherwise(F.regexp_replace(bare, r"^(.{3,}?)(?:ier|ie|er|e)$", "$1"))


def analysed(text: Column, french: bool = False, stems: bool = False) -> Column:
    """The terms of a text: letters and digits, lower-cased; with ``french``, without elisions and stop words; with ``stems``, stemmed."""
    if not french:
        return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"), 0)
    bare = F.transform(words, lambda w: F.regexp_replace(w, ELISIONS, ""))
    kept = F.filter(bare, lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.transform(kept, stemmed) if stems else kept
