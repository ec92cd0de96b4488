"""Toxicity: maximum-scoring segments over token log-odds, aggregated by extreme-value calibration.

Fit, on labelled rows only: for each token in how many toxic and other texts it stands, and its log-odds under a
Dirichlet prior that follows the token's overall share. Tokens are lower-cased words and the leading 3 to 7 characters
of words (in languages that inflect and compound, a telling stem stands in many rare words); a token counts once a text,
since a word that stands once tends to stand again. Tokens whose share of toxic texts is within chance (the root of the
likelihood ratio, which holds for tokens that never stand in one kind) count nothing. A word's weight is that of its
most telling token, less a drift, so that random text has a negative mean; when a word comes again in a text, nothing
but the drift is left of it.

Score: one pass over a text's word weights finds all maximal-scoring segments (linear time). Under the null the
best segment's excess over ln(K * words)/lambda is Gumbel; lambda solves E[exp(lambda*w)] = 1 over the words of
non-toxic texts, K is their rate of segments. A text's segments, each less that level, add up to -ln of how often
chance would give as much, and a logistic link maps that to a probability. Null and link are fitted out of fold: each
labelled text is weighed by log-odds that it had no part in.

Defined results: null and empty texts have no segment and get the score of a text without evidence; labels, lang,
source and doc_id are never inputs of a score; a document with several labels is toxic if one of them says so; a table
without labels of both kinds scores 0 everywhere; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mapped, texts


@dataclass(frozen=True)
class ToxicityParams:
    #: Labelled rows that the fit takes at most, by the hash of their id.
    sample: int = 20_000
    folds: int = 4
    #: The signed root of the likelihood ratio that a token needs.
    min_z: float = 4.0
    #: Total weight of the Dirichlet prior, in texts.
    prior: float = 30.0
    drift: float = 0.25
    #: Log-odds are cut here, so that one word can't decide alone.
    max_weight: float = 9.0
    min_weight: float = -1.0
    threshold: float = 0.7


WORD = re.compile(r"\w+")
LEADING = (3, 4, 5, 6, 7)


def tokens(word: str) -> list[str]:
    """The word, and its leading characters, marked as such."""
    return [word, *(f"{word[:n]}*" for n in LEADING if n <= len(word))]


def held_out(column) -> Column:
    return F.crc32(column.cast("string")) % 3 == 1


@dataclass(frozen=True)
class Model:
    #: token -> how telling it is, its log-odds
    tokens: dict[str, tuple[float, float]]
    drift: float
    rate: float = 1.0
    #: Segments that a word of a non-toxic text begins: the null's K.
    density: float = 1.0
    slope: float = 0.0
    offset: float = -50.0


def segments(weights: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in one pass with a stack of candidates."""
    stack: list[list[float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, w in enumerate(weights):
        if w <= 0:
            total += w
            continue
        entry = [i, i + 1, total, total + w]
        total += w
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= entry[2]:
                j -= 1
            if j < 0 or stack[j][3] >= entry[3]:
                stack.append(entry)
                break
            entry = [stack[j][0], entry[1], stack[j][2], entry[3]]
            del stack[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in stack]


class Scorer:
    def __init__(self, model: Model, cache: int = 200_000) -> None:
        self.model, self.words, self.cache = model, {}, cache

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            if len(self.words) >= self.cache:
                self.words.clear()
            told = [x for x in map(self.model.tokens.get, tokens(word)) if x]
            w = self.words[word] = (max(told)[1] if told else 0.0) - self.model.drift
        return w

    def weigh(self, text: str) -> list[float]:
        words = WORD.findall(text.lower())
        weights, seen = list(map(self.weight, words)), set()
        for i in [i for i, w in enumerate(weights) if w > 0]:
            if words[i] in seen:
                weights[i] = -self.model.drift
            seen.add(words[i])
        return weights

    def level(self, words: int) -> float:
        """ln of 1 plus the segments that a text so long has by chance."""
        return math.log1p(self.model.density * words)

    def judged(self, text: str) -> tuple[float, tuple[int, int, float] | None]:
        """-ln of the number of passages as good as the text's that chance would give, and the best passage in words."""
        weights = self.weigh(text)
        found, chance = segments(weights), self.level(len(weights))
        if not found:
            return -chance, None
        # Sum statistics: the best passage counts in full, others by what they exceed the level of chance.
        best = max(found, key=lambda x: x[2])
        level = chance / self.model.rate
        others = sum(x[2] - level for x in found if x is not best and x[2] > level)
        return self.model.rate * (best[2] + others) - chance, best

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.model.slope * evidence + self.model.offset))))


def log_odds(y: np.ndarray, n: np.ndarray, toxic: int, other: int, params: ToxicityParams) -> np.ndarray:
    """The log-odds of tokens in y toxic and n other texts, under the Dirichlet prior."""
    share = (y + n) / (toxic + other)
    a, b = params.prior * share, params.prior * (1 - share)
    delta = np.log((y + a) / (toxic - y + b)) - np.log((n + a) / (other - n + b))
    return np.clip(delta, params.min_weight, params.max_weight)


def signed_root(y: Column, n: Column, toxic: int, other: int) -> Column:
    """The likelihood ratio's root: how far a token's shares of toxic and other texts lie apart, in standard normal terms."""
    part = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)
    whole = lambda x: x * math.log(x) if x else 0.0
    ratio = part(y) + part(n) + part(toxic - y) + part(other - n) - part(y + n) - part(toxic + other - y - n)
    root = F.sqrt(F.greatest(F.lit(0.0), 2 * (ratio - whole(toxic) - whole(other) + whole(toxic + other))))
    return F.when(y * other > n * toxic, root).otherwise(-root)


def rate_of(weights: np.ndarray) -> float:
    """lambda > 0 with mean exp(lambda * w) = 1, by bisection; weights have a negative mean and some positive ones."""
    if not len(weights) or weights.max() <= 0:
        return 1.0
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        if np.exp(np.minimum(mid * weights, 700)).mean() > 1:
            high = mid
        else:
            low = mid
    return max(0.05, (low + high) / 2)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit, by Newton steps with a small ridge."""
    scale = max(1.0, float(np.abs(x).max()) / 10)
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - 0.01 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0) / scale), float(beta[1])


#: Counts that a task gathers before it hands them on.
AT_ONCE = 300_000


def counted(batches):
    """In how many toxic and other texts of each fold a token stands."""
    counts: Counter = Counter()

    def handed_on() -> pd.DataFrame:
        out = pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["token", "fold", "toxic", "n"])
        counts.clear()
        return out

    for batch in batches:
        for fold, toxic, text in zip(batch["fold"].tolist(), batch["toxic"].tolist(), batch["text"], strict=True):
            counts.update((t, fold, toxic) for t in {t for w in set(WORD.findall(text.lower())) for t in tokens(w)})
            if len(counts) >= AT_ONCE:
                yield handed_on()
    yield handed_on()


def models(rows: DataFrame, params: ToxicityParams) -> list[Model] | None:
    """Token weights without each fold in turn, and last those of all rows; None without rows of both kinds."""
    sizes = np.zeros((2, params.folds), int)
    for r in rows.groupBy("fold", "toxic").count().collect():
        sizes[r["toxic"], r["fold"]] = r["count"]
    if not sizes.sum(axis=1).all():
        return None
    sums = [F.sum(F.when((F.col("toxic") == k) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"{name}{f}") for k, name in ((1, "y"), (0, "n")) for f in range(params.folds)]
    table = rows.mapInPandas(counted, "token string, fold int, toxic int, n long").groupBy("token").agg(*sums)
    without = [*range(params.folds), None]
    in_fold = lambda name, f: sum((F.col(f"{name}{k}") for k in range(params.folds) if k != f), F.lit(0))
    roots = []
    for f in without:
        other, toxic = (sizes[k].sum() - (0 if f is None else sizes[k, f]) for k in (0, 1))
        roots.append(signed_root(in_fold("y", f), in_fold("n", f), int(toxic), int(other)).alias(f"z{'' if f is None else f}"))
    # The tokens that tell anything: few of all.
    told = table.select("*", *roots).filter(" or ".join(f"abs(z{'' if f is None else f}) >= {params.min_z}" for f in without)).toPandas()
    y, n = (told[[f"{name}{f}" for f in range(params.folds)]].to_numpy(float) for name in "yn")
    out = []
    for f in without:
        keep = np.arange(params.folds) != (-1 if f is None else f)
        z = np.abs(told[f"z{'' if f is None else f}"].to_numpy())
        weights = log_odds(y[:, keep].sum(axis=1), n[:, keep].sum(axis=1), int(sizes[1, keep].sum()), int(sizes[0, keep].sum()), params)
        enough = z >= params.min_z
        out.append(Model(dict(zip(told["token"][enough], zip(z[enough].tolist(), weights[enough].tolist(), strict=True), strict=True)), params.drift))
    return out


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(params.folds)).cast("int")
    # At most ``sample`` labels: a side of bounded size.
    rows = scratch.write(texts(docs).join(F.broadcast(chosen), "doc_id").select(fold.alias("fold"), "toxic", "text"), "labelled")
    found = models(rows, params)
    if found is None:
        return Model({}, params.drift)
    *apart, whole = found

    def nulls(batches):
        scorers = [Scorer(m) for m in apart]
        for batch in batches:
            seen: Counter = Counter()
            for fold, text in zip(batch["fold"].tolist(), batch["text"], strict=True):
                weights = scorers[fold].weigh(text)
                seen[math.inf] += len(segments(weights))  # under that key
                seen.update(round(w, 2) for w in weights)
            yield pd.DataFrame(list(seen.items()), columns=["weight", "n"])

    null = rows.filter("toxic = 0").select("fold", "text").mapInPandas(nulls, "weight double, n long").groupBy("weight").agg(F.sum("n").alias("n")).toPandas()
    begun, null = int(null.loc[np.isinf(null["weight"]), "n"].sum()), null[~np.isinf(null["weight"])]
    total, rate = int(null["n"].sum()), 1.0
    if total:  # thinned in proportion, for the mean alone
        rate = rate_of(np.repeat(null["weight"].to_numpy(), np.ceil(null["n"] / max(1, total // 100_000)).astype(int)))
    calibrated = {"rate": min(1.0, rate), "density": (begun + 1) / (total + 1)}
    apart = [replace(m, **calibrated) for m in apart]

    def evidence(batches):
        scorers = [Scorer(m) for m in apart]
        for batch in batches:
            x = [scorers[f].judged(t)[0] for f, t in zip(batch["fold"].tolist(), batch["text"], strict=True)]
            yield pd.DataFrame({"toxic": batch["toxic"], "x": x})

    seen = rows.mapInPandas(evidence, "toxic int, x double").toPandas()
    scratch.drop("labelled")
    slope, offset = logistic(seen["x"].to_numpy(), seen["toxic"].to_numpy(float))
    return replace(whole, **calibrated, slope=slope, offset=offset)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the best passage (words from 0, end exclusive) of each row."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.judged(t) for t in batch["text"]]
            first, end = (pd.array([best and best[k] for _, best in found], "Int64") for k in (0, 1))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [scorer.score(x) for x, _ in found], "first_word": first, "end_word": end})

    return mapped(docs, run, "doc_id long, score double, first_word long, end_word long")


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Scores of all rows, from the labels that aren't held out."""
    out = scored(docs, fit(docs, labels.filter(~held_out(F.col("doc_id"))), params))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= params.threshold, 1).otherwise(0).cast("int").alias("predicted"), "first_word", "end_word")
