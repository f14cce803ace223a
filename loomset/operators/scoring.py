"""Batched scoring of prompts with a caller's model, and judging of responses."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from loomset.functions.chat import JUDGE_CRITERIA
from loomset.functions.text import first_tokens, strip
from loomset.operators.chatting import judge_prompts
from loomset.runtime import ship

# Prompts per model call, and where prompts are cut for generating and for judging.
BATCH_SIZE = 8
PROMPT_TOKENS = 2048
JUDGE_TOKENS = 1024

_ASKED = "_asked"  # what the model gets to see of a prompt
_resident: dict[Hashable, Any] = {}


def resident(key: Hashable, load: Callable[[], Any]) -> Any:
    """The model under ``key``, loaded once per Python worker; a worker keeps one at a time."""
    if key not in _resident:
        model = load()
        _resident.clear()
        _resident[key] = model
    return _resident[key]


def batch_score(df: DataFrame, load: Callable[[], Any], score: Callable[[Any, list[str]], list[str]],
                model_key: Hashable | None = None, prompt: str = "prompt", response: str = "response",
                batch_size: int = BATCH_SIZE, prompt_limit: int | None = PROMPT_TOKENS) -> DataFrame:
    """Add ``response`` and ``error``: ``score(model, prompts)`` on at most ``batch_size`` prompts at once.

    The model gets prompts up to their token number ``prompt_limit``, and shorter ones, or all
    with None, as they are; the ``prompt`` column itself is never cut.

    Workers keep the model for the tasks of this call, or of every call with the same ``model_key``.
    A batch that raises is scored again row by row, so only the failing rows carry an
    error and none is lost.
    """
    ship(df.sparkSession)
    if model_key is None:
        model_key = uuid.uuid4().hex
    schema = T.StructType(
        df.schema.fields + [T.StructField(response, T.StringType()), T.StructField("error", T.StringType())]
    )

    def one(model: Any, text: str) -> tuple[str | None, str | None]:
        try:
            return score(model, [text])[0], None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def many(model: Any, texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            out = score(model, texts)
            if len(out) == len(texts):
                return [(o, None) for o in out]
        except Exception:
            pass
        return [one(model, t) for t in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from loomset.operators.scoring import resident as keep  # the worker's own module outlives the task

        model = keep(model_key, load)
        for frame in frames:
            texts = frame.pop(_ASKED).tolist()
            scored = [
                pair
                for start in range(0, len(texts), batch_size)
                for pair in many(model, texts[start : start + batch_size])
            ]
            yield frame.assign(**{response: [s for s, _ in scored], "error": [e for _, e in scored]})

    asked = F.col(prompt) if prompt_limit is None else first_tokens(prompt, prompt_limit)
    return df.withColumn(_ASKED, asked).mapInPandas(run, schema)


def judge(df: DataFrame, key: str, load: Callable[[], Any], score: Callable[[Any, list[str]], list[str]],
          criteria: tuple[str, ...] = JUDGE_CRITERIA, response: str = "response",
          prompt_limit: int | None = JUDGE_TOKENS, **options) -> DataFrame:
    """(key, criterion, judgment, error): a judge model's stripped verdict per row and criterion."""
    asked = judge_prompts(df, key, response=response, criteria=criteria).select(key, "criterion", "judge_prompt")
    judged = batch_score(
        asked, load, score, prompt="judge_prompt", response="judgment", prompt_limit=prompt_limit, **options
    )
    return judged.select(key, "criterion", strip("judgment").alias("judgment"), "error")
