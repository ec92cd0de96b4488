"""License scans: ordered signature rules behind a keyword prefilter.

A text's words (A to Z lower-cased) joined by single spaces are what the signatures match, so line breaks and
punctuation don't hide a notice. A rule has a priority, a label and a pattern over words; its keyword is the longest word
that every match holds, and it is tried only where that stands in the text. Rules are ordered by priority and then by
their place in the list. Of overlapping detections, one that lies inside another of the same or a higher priority goes
(of equal intervals the first rule's stays); what is left gives the method's labels. The base phrases keep their labels
whatever the rules say.

Defined results: null and empty texts have no words and no labels; repeated rows give repeated results; an empty
table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame

from .common import mapped
from .license_rules import SECTIONS, VERSION

# The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: bytes
    pattern: re.Pattern


def keyword_of(pattern: str) -> str:
    """The longest word that stands outside of groups, classes and what may be left out."""
    def parted(group: re.Match) -> str:
        ways = group[1].split("|")
        return " " if all(w[:1] == " " or w[-1:] == " " for w in ways) else "*"

    plain = re.sub(r"\[[^\]]*\]|\.\{[^}]*\}|.\?(?!:)", "*", re.sub(r"(\([^()]*\))\?", r"\1", pattern))
    while "(" in plain:
        plain = re.sub(r"\(\?:([^()]*)\)[?*]?", parted, plain)
    return max((w for w in plain.split() if w.isalnum()), key=len)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    found = []
    for priority, section in SECTIONS:
        for line in section.strip().splitlines():
            label, pattern = line.split(": ", 1)
            found.append(Rule(priority, label, keyword_of(pattern.replace("V?", "")).encode(), re.compile(f" {pattern.replace('V?', VERSION)}(?= )".encode())))
    return tuple(found)


def gates() -> re.Pattern:
    """Any keyword, as a word: texts without one need no rule."""
    return re.compile(b" (?:" + b"|".join(sorted({r.keyword for r in rules()}, key=len, reverse=True)) + b")(?= )")


#: What isn't part of a word becomes a space: U+0000 to U+002F, U+003A to U+0060, U+007B to U+007F; A to Z go lower first.
TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def kept(hits: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The hits (start, end, priority, label) that lie inside no other one of the same or a higher priority."""
    out, starts, reach = [], [], []  # of the higher priorities: starts in order, the furthest end up to each
    hits = sorted(hits, key=lambda h: -h[2])
    for _, same in groupby(hits, key=lambda h: h[2]):
        best, own = -1, []
        for h in sorted(same, key=lambda h: (h[0], -h[1])):
            above = bisect_right(starts, h[0]) - 1
            if h[1] > best and (above < 0 or reach[above] < h[1]):
                own.append(h)
            best = max(best, h[1])
        out += own
        ends = sorted((h[0], h[1]) for h in out)
        starts, reach = [a for a, _ in ends], list(accumulate((b for _, b in ends), max))
    return sorted(out)


def detections(padded: bytes, keywords: set[bytes]) -> list[tuple[int, int, int, str]]:
    """start, end, priority, label of the detections that no other one suppresses; offsets in the padded words."""
    return kept([(m.start() + 1, m.end(), r.priority, r.label) for r in rules() if r.keyword in keywords for m in r.pattern.finditer(padded)])


def scan(text: str, gate: re.Pattern) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = text.encode().translate(TO_WORDS).split()
    padded = b" " + b" ".join(words) + b" "
    keywords = {m[0][1:] for m in gate.finditer(padded)}
    starts, base = [], set()
    for phrase, label in PHRASES:
        needle, at = f" {phrase} ".encode(), -1
        while (at := padded.find(needle, at + 1)) >= 0:
            starts.append(at)
            base.add(label)
    found = detections(padded, keywords) if keywords else []
    labels = base | {h[3] for h in found}
    score = max((h[2] / 4 for h in found), default=0.25 if base else 0.0)
    word_of = lambda at: padded.count(b" ", 0, at)
    return len(words), len(starts), word_of(min(starts)) if starts else None, word_of(max(starts)) if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    def run(batches):
        gate = gates()
        for batch in batches:
            rows = [(d, *scan(t, gate)) for d, t in zip(batch["doc_id"], batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return mapped(docs, run, SCHEMA)
