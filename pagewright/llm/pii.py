r"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

DataFrame functions only. Each kind has a pattern, a validator (octet range, Luhn, digit count, mod-97, number
ranges) and a prior score; words near a span raise it. The four base kinds keep every valid match whatever its
score; the kinds that the method adds (iban, ssn, local_phone, secret, key) need ``min_score``.

Patterns are written for the JVM: possessive quantifiers where nothing after them could need a shorter match, and
a look-behind (or ``\G``, the end of the match before) in place of the starts inside a run that can't match if the
run's own start doesn't. Both keep the leftmost matches and make the search linear in runs of any length.

Defined results: null text is an empty text without spans; offsets are code points, ends exclusive; repeated rows
give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

# The patterns of the kinds, in the order of the result.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:password|passwd|passphrase|pwd|(?:client[_-]?)?secret|api[_-]?key|access[_-]?key|(?:auth|access|refresh)?[_-]?token)[\x20\t]{0,3}[=:][\x20\t]{0,3}(?:\"[^\"\x00-\x1F]{8,128}\"|'[^'\x00-\x1F]{8,128}'|[^\x00-\x20\"']{8,128})",
    "key": r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,64}|xox[abprs]-[A-Za-z0-9-]{10,80}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,512}\.eyJ[A-Za-z0-9_-]{8,2048}\.[A-Za-z0-9_-]{8,512}|-----BEGIN\x20(?:[A-Z]{2,10}\x20)?PRIVATE\x20KEY-----)(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this can't have the kind; a plain look spares most texts the pattern.
NEEDS = {"email": "[^@]*@", "phone": "[^+]*[+]", "secret": "[^=:]*[=:]"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "local_phone": 0.4, "secret": 0.9, "key": 0.95}
CONTEXT = {
    "email": "mail|contact|write|address|correo|kontakt",
    "ip": "server|host|login|address|client|network",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|cell|contact|whatsapp",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer|tax id",
    "local_phone": "phone|call|tel|fax|mobile|cell|contact",
}


#: Matches that are placed at once, and code points of a piece of text.
BLOCK, PIECE = 128, 1024


@dataclass(frozen=True)
class PiiParams:
    min_score: float = 0.6
    #: What a context word nearby adds to the prior score.
    context_gain: float = 0.35
    #: Code points before and after a span in which context words count.
    context_reach: int = 40


def spans_of(kind: str, text: str) -> Column:
    """array<struct<start, end, match>> of all leftmost non-overlapping matches, not yet validated."""
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    span = "struct(a.at + char_length(x.g) as start, a.at + char_length(x.g) + char_length(x.m) as end, x.m as match)"
    after = "a.at + char_length(x.g) + char_length(x.m)"
    empty = "cast(array() as array<struct<start:bigint,end:bigint,match:string>>)"
    # Appending copies an array, so matches are placed by blocks: first where each block begins, then within it.
    pairs = f"filter(zip_with(regexp_extract_all({text}, '{pattern}', 0), split({text}, '{pattern}', -1), (m, g) -> struct(m, g)), x -> x.m is not null)"
    blocks = f"transform(sequence(0, (size(p) - 1) div {BLOCK}), b -> slice(p, cast(b * {BLOCK} + 1 as int), {BLOCK}))"
    starts = f"aggregate(bs, struct(0L as at, cast(array() as array<bigint>) as s), (a, b) -> struct(aggregate(b, a.at, (at, x) -> at + char_length(x.g) + char_length(x.m)) as at, concat(a.s, array(a.at)) as s), a -> a.s)"
    within = f"aggregate(b, struct(begin as at, {empty} as spans), (a, x) -> struct({after} as at, concat(a.spans, array({span})) as spans), a -> a.spans)"
    placed = f"get(transform(array({blocks}), bs -> flatten(zip_with(bs, {starts}, (b, begin) -> {within}))), 0)"
    return F.expr(f"get(transform(array({pairs}), p -> if(size(p) = 0, {empty}, {placed})), 0)")


def part(start: str, length: str) -> str:
    """SQL of at most a piece's length of the text, from the two pieces that it can lie in."""
    k = f"cast({start} div {PIECE} as int)"
    both = f"concat(coalesce(get(pieces, {k}), ''), coalesce(get(pieces, {k} + 1), ''))"
    return f"substring({both}, cast({start} % {PIECE} as int) + 1, cast({length} as int))"


def valid(kind: str, match: str = "x.match") -> str:
    """The SQL condition that a match must meet."""
    return {
        "email": "true",
        "ip": f"forall(split({match}, '[.]'), p -> char_length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
        "card": f"char_length(translate({match}, ' -', '')) between 13 and 19 and luhn_check(translate({match}, ' -', ''))",
        "phone": f"char_length(translate({match}, '+ ().-', '')) between 9 and 15",
        # mod-97: the first four characters go to the end, letters count 10 to 35, the remainder is 1.
        "iban": f"""char_length(translate({match}, ' ', '')) between 15 and 34 and aggregate(
                      split(concat(substring(translate({match}, ' ', ''), 5), substring(translate({match}, ' ', ''), 1, 4)), ''), 0,
                      (a, c) -> case when c = '' then a when c < 'A' then (a * 10 + ascii(c) - 48) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1""",
        "ssn": f"substring({match}, 1, 3) not in ('000', '666') and substring({match}, 1, 1) <> '9' and substring({match}, 5, 2) <> '00' and substring({match}, 8) <> '0000'",
        "local_phone": f"substring({match}, 2, 1) >= '2'",
        # What follows a colon is a secret if it has a digit: prose doesn't.
        "secret": f"{match} rlike '^[^:]*=' or {match} rlike '[0-9]'",
        "key": "true",
    }[kind]


def pii_spans(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id and, per kind, an array of spans (start, end, match, score), in the order of the text."""
    if params.context_reach > PIECE:
        raise ValueError(f"context_reach must be {PIECE} or less")
    rows = texts(docs)
    found = {}
    for kind, pattern in PATTERNS.items():
        gate = F.col("text").rlike("^" + NEEDS[kind]) if kind in NEEDS else F.lit(True)
        found[f"raw_{kind}"] = F.when(gate & F.col("text").rlike(pattern), spans_of(kind, "text")).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,match:string>>)"))
    # Pieces of the text, for what stands near a span: taking a part of the whole text walks through it from its beginning.
    rows = rows.withColumns(found | {"pieces": F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))})
    scored = {}
    for kind in PATTERNS:
        score = f"cast({PRIOR[kind]} as double)"
        if kind in CONTEXT:
            reach = params.context_reach
            before = part("greatest(x.start - {reach}, 0)", "x.start - greatest(x.start - {reach}, 0)").format(reach=reach)
            near = f"lower(concat({before}, ' ', {part('x.end', str(reach))}))"
            score = f"least(1.0D, {score} + if({near} rlike '{CONTEXT[kind]}', {params.context_gain}D, 0.0D))"
        kept = "" if kind in BASE else f" and x.score >= {params.min_score}"
        scored[kind] = F.expr(f"filter(transform(filter(raw_{kind}, x -> {valid(kind)}), x -> struct(x.start, x.end, x.match, {score} as score)), x -> true{kept})")
    return rows.select("doc_id", *[c.alias(kind) for kind, c in scored.items()])


def listed(kinds) -> Column:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))

    return F.array_join(F.concat(*[named(kind) for kind in kinds]), ",")


def pii_digest(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    found = pii_spans(docs, params)
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(PATTERNS).alias("spans"),
        sum((F.size(kind) for kind in PATTERNS), F.lit(0)).cast("long").alias("n_spans"),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS if kind not in BASE],
    )
