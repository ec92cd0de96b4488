"""Model calls as DataFrame operators around an injected callable: embed, generate, transcribe.

The callable gets a batch and returns as many results, in order; a wrong count, an empty or a ragged vector, or an
empty answer is an error of the whole task, never a silent gap. One callable is made for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EMBED_BATCH
from ..session import with_code
from .text import unfenced

Batch = Callable[[Sequence], Sequence]


def batches(values: Sequence, size: int, call: Batch) -> list:
    out = []
    for at in range(0, len(values), size):
        part = list(values[at : at + size])
        got = list(call(part))
        if len(got) != len(part):
            raise ValueError(f"{len(part)} inputs gave {len(got)} results")
        out += got
    return out


def _mapped(df: DataFrame, column: str, result: str, kind: str, make: Callable[[], Batch], size: int, check: Callable) -> DataFrame:
    with_code(df.sparkSession)

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = make()
        for values in parts:
            yield pd.Series([check(x) for x in batches(values.tolist(), size, call)], dtype=object)

    return df.withColumn(result, run(column))


def embedded(df: DataFrame, make: Callable[[], Batch], dim: int, column: str = "content", size: int = EMBED_BATCH) -> DataFrame:
    """``df`` with its vectors: text and vector stay in one row, so they can't drift apart."""

    def check(vector: Sequence[float]) -> list[float]:
        if len(vector) != dim:
            raise ValueError(f"a vector of {len(vector)} numbers, not {dim}")
        return [float(x) for x in vector]

    return _mapped(df, column, "embedding", "array<float>", make, size, check)


def _not_empty(text: str) -> str:
    if not text or not text.strip():
        raise ValueError("the model gave nothing")
    return text


def transcribed(images: DataFrame, make: Callable[[], Batch], column: str = "content") -> DataFrame:
    """Image bytes to markdown, out of the fence that models like to wrap it in."""
    out = _mapped(images, column, "content_markdown", "string", make, 1, _not_empty)
    return out.withColumn("content_markdown", unfenced(F.col("content_markdown")))


def generated(prompts: DataFrame, make: Callable[[], Batch], max_chars: int, column: str = "prompt") -> DataFrame:
    """Answers to prompts; a prompt over the budget is refused before the model sees it, a null one isn't sent."""
    size = F.char_length(column)
    checked = prompts.withColumn(column, F.when(F.coalesce(size, F.lit(0)) <= max_chars, F.col(column)).otherwise(F.raise_error("the prompt is longer than the context")))
    asked = _mapped(checked.filter(F.col(column).isNotNull()), column, "answer", "string", make, 1, _not_empty)
    return asked.unionByName(checked.filter(F.col(column).isNull()).withColumn("answer", F.lit(None).cast("string")))
