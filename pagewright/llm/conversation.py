"""Conversation repair: the cheapest edits that give a legal order of roles, by a forward Viterbi pass.

The legal orders are ``(s?(ua)+)?`` over the initials of roles. The grammar has four states: nothing yet, after system,
after user, after assistant. For each state the pass carries the smallest (cost, audit) that leads there; each row closes
its layer with insertions, of which two in a row reach any state that insertions can reach. A path's audit names its
states, so of two paths to one state none is the beginning of the other unless it costs less, and the smallest pair
can be kept without looking ahead.

A conversation may be of any length. Rows are sorted by range over all conversations, so that one conversation may lie
in several tasks; a task turns each stretch of it into a table of smallest pairs from every state to every state, and
the tables of a conversation are applied in order. Only small rows (a digest of the text, the initial, the fault) take
part. Texts travel once, in the last step, where they pass by one at a time for the hash: nothing of a conversation but its audit is held.

Defined results: null roles and texts are one space; a null conv_id is a conversation of its own, and conv_id and turn
count as one space in the damage's key; null turns come first; equal turns go by role, then by the text's SHA-256, so
repeated rows are adjacent; a role without an initial, or with another than s, u, a, can't be kept; an empty table gives
an empty result; further columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_code

# What counts as a character of a text, ends of sentences, and the damage by remainder.
BLANK = r"[\x20\x09-\x0D]"
ENDS = r"[.!?]"
DAMAGE_OF, DROPPED, EMPTIED, UNENDED, REPEATED, TURNED = 20, 0, 1, 2, 3, 4


@dataclass(frozen=True)
class RepairParams:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    #: Rows of one conversation that one table of pairs stands for.
    stretch: int = 4096


START, SYSTEM, USER, ASSISTANT = range(4)
#: What may come after each state, by the initial that is read.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
TURN = {"u": "user", "a": "assistant"}
Layer = tuple["tuple[int, str] | None", ...]
#: Most conversations are short and alike: steps of audits up to this length are kept, so many at most in a worker.
SHORT, KEPT = 16, 50_000


def closed(layer: Layer, cost: int) -> Layer:
    """With insertions: two rounds, as no state is further away."""
    for _ in range(2):
        grown = list(layer)
        for state, best in enumerate(layer):
            if best:
                for initial in "ua":
                    to = NEXT[state].get(initial)
                    if to is not None:
                        grown[to] = min(x for x in (grown[to], (best[0] + cost, best[1] + "I")) if x)
        layer = tuple(grown)
    return layer


def step(layer: Layer, initial: str, fault: str, times: int, p: RepairParams) -> Layer:
    """One row more, from what is kept where the layer is short."""
    short = max(len(best[1]) if best else 0 for best in layer) <= SHORT
    return (_kept_step if short and times == 1 else _step)(layer, initial, fault, times, p)


def _step(layer: Layer, initial: str, fault: str, times: int, p: RepairParams) -> Layer:
    """One row more: deleted, kept or given the role that the grammar asks for, then closed. Its repeats must go."""
    after = [best and (best[0] + p.delete, best[1] + "D") for best in layer]
    if fault not in ("blank", "duplicate"):
        extra = p.truncated if fault == "truncated" else 0
        for state, best in enumerate(layer):
            if best:
                for mark, price, way in (("K", 0, initial), ("R", p.rerole, "u"), ("R", p.rerole, "a")):
                    to = NEXT[state].get(way)
                    if to is not None:
                        new = (best[0] + price + extra, best[1] + mark)
                        if after[to] is None or new < after[to]:
                            after[to] = new
    if times > 1:
        # Insertions before a deletion sort behind those after it, so the layer is closed once, at the end.
        after = [best and (best[0] + p.delete * (times - 1), best[1] + "D" * (times - 1)) for best in after]
    return closed(tuple(after), p.insert)


_kept_step = lru_cache(KEPT)(_step)


def applied(layer: Layer, table: list[Layer]) -> Layer:
    """The layer after a stretch: from each state to each state."""
    out: list = [None] * 4
    for best, row in zip(layer, table):
        if best:
            for to, way in enumerate(row):
                if way:
                    new = (best[0] + way[0], best[1] + way[1])
                    if out[to] is None or new < out[to]:
                        out[to] = new
    return tuple(out)


KEY = ("conv_id", "turn", "role", "digest")
STRETCHES = "conv_id string, turn string, role string, digest string, costs array<long>, audits array<string>, first string, last string, n_blank long, n_duplicate long, n_truncated long, n_illegal long"
COUNTS = ("blank", "duplicate", "truncated")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_COLUMNS = [c.split(" ")[0] for c in RESULT.split(", ")]
PAIRS = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: rows as stored, with their damage; times is 0 for a row that is dropped, 2 for a repeat."""
    space = lambda c: F.coalesce(c, F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space(F.col("conv_id").cast("string")), space(F.col("turn").cast("string")))) % DAMAGE_OF
    text = F.when(kind == EMPTIED, "").when(kind == UNENDED, F.regexp_replace(space(F.col("text")), ENDS, "")).otherwise(space(F.col("text")))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == TURNED, "user").otherwise(space(F.col("role"))).alias("role"),
        text.alias("text"), F.when(kind == DROPPED, 0).when(kind == REPEATED, 2).otherwise(1).cast("long").alias("times"),
    )


def untouched(rows: DataFrame) -> DataFrame:
    """The same columns without damage: repair as it is used on real conversations."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(1).cast("long").alias("times"))


def faults(rows: DataFrame) -> DataFrame:
    """One row for all equal rows of a conversation: their number, and the first one's fault."""
    shown = F.regexp_replace("text", BLANK, "")
    own = rows.filter("times > 0").select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.when(shown == "", "blank").when(~F.substring(shown, -1, 1).rlike(ENDS), "truncated").alias("fault"), "times"
    )
    counted = own.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("times").alias("times"), F.first("fault").alias("fault"))
    # Structs order a null turn before others, and compare where it is null.
    first = counted.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("begins"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    late = F.struct("turn") > F.col("begins")
    fault = F.when(F.col("fault") == "blank", "blank").when(late, "duplicate").otherwise(F.coalesce("fault", F.lit("")))
    return counted.join(first, same).select("conv_id", "turn", "role", "digest", fault.alias("fault"), "times")


def _stretches(p: RepairParams):
    def run(batches):
        def rows():
            held = _Stretch(p)
            for batch in batches:
                for row in batch.itertuples(index=False, name=None):
                    if held.n and (held.n == p.stretch or row[0] != held.conv):
                        yield held.out()
                    if not held.n:
                        held.begin(row)
                    held.add(row)
            if held.n:
                yield held.out()

        yield from _blocks(rows(), [c.split(" ")[0] for c in STRETCHES.split(", ")], 200)

    return run


class _Stretch:
    """Consecutive rows of one conversation, as a table of smallest pairs."""

    def __init__(self, p: RepairParams) -> None:
        self.p, self.n, self.conv = p, 0, None

    def begin(self, row) -> None:
        # A conversation that follows another one of this task begins here; any other may go on from any state.
        entries = (START,) if self.conv is not None and self.conv != row[0] else range(4)
        self.table = [closed(tuple((0, "") if i == k else None for i in range(4)), self.p.insert) if k in entries else None for k in range(4)]
        self.key, self.conv, self.first, self.last, self.illegal = row[:4], row[0], row[2][:1], None, 0
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, row) -> None:
        initial, fault, times = row[2][:1], row[4], int(row[5])
        self.table = [layer and step(layer, initial, fault, times, self.p) for layer in self.table]
        self.illegal += (self.last is not None and self.last + initial not in PAIRS) + times - 1  # no pair is of two like initials
        if fault:
            self.counts[fault] += 1
        if times > 1:  # an equal row that is blank is blank again; any other one has been seen
            self.counts["blank" if fault == "blank" else "duplicate"] += times - 1
        self.last, self.n = initial, self.n + 1

    def out(self) -> dict:
        flat = [x for layer in self.table for x in layer or [None] * 4]
        self.n = 0
        return {
            **dict(zip(KEY, self.key)), "costs": [x[0] if x else -1 for x in flat], "audits": [x[1] if x else "" for x in flat], "first": self.first, "last": self.last,
            **{f"n_{c}": self.counts[c] for c in COUNTS}, "n_illegal": self.illegal,
        }


class _Conversation:
    """One conversation in its last task: its stretches first, then its rows as stored, one at a time."""

    def __init__(self, conv: str) -> None:
        self.conv, self.layer, self.audit = conv, ((0, ""), None, None, None), None
        self.counts, self.illegal, self.last = dict.fromkeys(COUNTS, 0), 0, None
        self.low = self.high = None
        self.turns, self.state, self.at = 0, START, 0

    def stretch(self, row) -> None:
        flat = [(int(c), a) if c >= 0 else None for c, a in zip(row.costs, row.audits)]
        self.layer = applied(self.layer, [tuple(flat[k : k + 4]) for k in range(0, 16, 4)])
        for c in COUNTS:
            self.counts[c] += int(getattr(row, f"n_{c}"))
        self.illegal += int(row.n_illegal) + (self.last is not None and self.last + row.first not in PAIRS)
        self.last = row.last

    def _decide(self) -> None:
        if self.audit is None:
            self.cost, self.audit = min(x for x in (self.layer[START], self.layer[ASSISTANT]) if x)

    def _asked(self) -> str:
        return TURN["u" if "u" in NEXT[self.state] else "a"]

    def _inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            role = self._asked()
            self.state, self.at = NEXT[self.state][role[0]], self.at + 1
            yield "I", role, ""

    def row(self, row):
        """(edit, role, text) of what the repaired conversation has up to this row."""
        self._decide()
        if row.times and row.turn:
            turn = int(row.turn)
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        for _ in range(int(row.times)):
            yield from self._inserted()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit != "D":
                role = row.role if edit == "K" else self._asked()
                self.state = NEXT[self.state][role[0]]
                yield edit, role, row.text

    def end(self):
        """What is inserted behind the last row."""
        self._decide()
        yield from self._inserted()

    def result(self) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.cost, "audit": self.audit}


def _events(batches):
    """(conversation, edited rows): an item for each row as stored, and one with None for the end of a conversation."""
    held = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if held is None or row.conv != held.conv:
                if held is not None:
                    yield from ((held, held.end()), (held, None))
                held = _Conversation(row.conv)
            if row.costs is not None:
                held.stretch(row)
            else:
                yield held, held.row(row)
    if held is not None:
        yield from ((held, held.end()), (held, None))


def _blocks(rows, columns: list[str], size: int = 1000):
    block = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pd.DataFrame(block, columns=columns)
            block = []
    if block:
        yield pd.DataFrame(block, columns=columns)


def _digested(batches):
    """The results, with the hash of each repaired conversation as its texts pass."""

    def rows():
        digest, begun = hashlib.sha256(), False
        for held, edited in _events(batches):
            if edited is None:
                yield held.result() | {"repaired_sha256": digest.hexdigest()}
                digest, begun = hashlib.sha256(), False
                continue
            for _, role, text in edited:
                digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                begun = True

    yield from _blocks(rows(), RESULT_COLUMNS)


def _written(batches):
    """The repaired conversations, row by row."""

    def rows():
        position = 0
        for held, edited in _events(batches):
            if edited is None:
                position = 0
                continue
            for edit, role, text in edited:
                yield held.conv, position, edit, role, text
                position += 1

    yield from _blocks(rows(), ["conv_id", "position", "edit", "role", "text"], 100)


def _decided(rows: DataFrame, params: RepairParams, damage: bool) -> DataFrame:
    """Each conversation in one task, in order: its stretches with their costs, then its rows."""
    if min(params.rerole, params.delete, params.insert, params.truncated, params.stretch) < 1:
        raise ValueError("every edit costs 1 or more")
    with_code(rows.sparkSession)
    taken = damaged(rows) if damage else untouched(rows)
    # The sort key has the turn in it, so one long conversation is spread over tasks as well as many short ones.
    small = faults(taken).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)  # noqa: E731  pandas makes floats of whole numbers beside nulls
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("long")
    parts = small.select(text("conv_id"), text("turn"), "role", "digest", "fault", "times").mapInPandas(_stretches(params), STRETCHES)
    parts = parts.withColumns({"conv_id": number("conv_id"), "turn": number("turn"), "kind": F.lit(0)})
    stored = taken.withColumns({"digest": F.sha2("text", 256), "kind": F.lit(1)})
    both = parts.unionByName(stored, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *KEY[1:])
    return both.select(text("conv_id").alias("conv"), text("turn"), "role", "text", "times", "costs", "audits", "first", "last", *(f"n_{c}" for c in COUNTS), "n_illegal")


def repair(rows: DataFrame, params: RepairParams = RepairParams(), damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conv_id.

    With ``damage`` the rows are damaged first, which tests the repair; without it they are taken as they are.
    """
    out = _decided(rows, params, damage).mapInPandas(_digested, RESULT.replace("conv_id long", "conv_id string"))
    return out.withColumn("conv_id", F.nullif(F.col("conv_id"), F.lit("")).cast("long"))


def repaired(rows: DataFrame, params: RepairParams = RepairParams(), damage: bool = False) -> DataFrame:
    """conv_id, position (from 0), edit, role, text: the repaired conversations themselves, row by row."""
    out = _decided(rows, params, damage).mapInPandas(_written, "conv_id string, position long, edit string, role string, text string")
    return out.withColumn("conv_id", F.nullif(F.col("conv_id"), F.lit("")).cast("long"))
