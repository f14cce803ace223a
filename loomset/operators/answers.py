"""Scoring that survives a lost job: answers are kept under the digest of what was asked."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomset.functions.text import first_tokens
from loomset.operators.scoring import BATCH_SIZE, PROMPT_TOKENS, batch_score
from loomset.runtime import materialise

WAVE_ROWS = 20_000  # prompts whose answers are committed together

_SCHEMA = "digest string, response string, error string"
_DIGEST, _SEEN = "_digest", "_seen"


class AnswerStore:
    """Answers below one folder, each wave a folder of its own; what a wave has committed is never written again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def rows(self) -> DataFrame:
        """All answers and errors so far, as committed."""
        try:
            return self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _SCHEMA)

    def finished(self) -> DataFrame:
        """(digest) of the questions that have an answer; those that only failed are open."""
        return self.rows().where("error is null").select("digest").distinct()

    def answers(self) -> DataFrame:
        """(digest, response, error): an answer before an error, the least of several."""
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "response", "error")).alias("best")
        return self.rows().groupBy("digest").agg(best).select("digest", "best.response", "best.error")

    def commit(self, scored: DataFrame) -> None:
        scored.select("digest", "response", "error").write.parquet(f"{self.path}/wave-{uuid.uuid4().hex}")


def address(asked: Column, model: str, settings: dict[str, Any] | None = None) -> Column:
    """The digest of a question to a model; a NULL prompt differs from an empty one."""
    given = json.dumps([model, settings or {}], sort_keys=True)
    return F.sha2(F.concat(F.lit(given), F.when(asked.isNull(), "0").otherwise(F.concat(F.lit("1"), asked))), 256)


def resumed_score(df: DataFrame, path: str, load: Callable[[], Any], score: Callable[[Any, list[str]], list[str]],
                  model: str, settings: dict[str, Any] | None = None, prompt: str = "prompt", response: str = "response",
                  batch_size: int = BATCH_SIZE, prompt_limit: int | None = PROMPT_TOKENS, wave_rows: int = WAVE_ROWS) -> DataFrame:
    """As :func:`batch_score`, asking only what the store at ``path`` has no answer to.

    Equal prompts are asked once. Open ones are scored in waves of about ``wave_rows``; a wave's
    answers are committed before the next one starts, so that a job that dies is run again for
    the rest. ``model`` and ``settings`` name what answers depend on: another model or other settings are
    other questions. Errors are returned but not kept as answers: a rerun asks again.
    """
    store = AnswerStore(df.sparkSession, path)
    asked = F.col(prompt) if prompt_limit is None else first_tokens(prompt, prompt_limit)
    rows = df.withColumn(_DIGEST, address(asked, model, settings))
    questions = rows.select(F.col(_DIGEST).alias("digest"), asked.alias(_SEEN)).dropDuplicates(["digest"])
    questions = materialise(questions.join(store.finished(), "digest", "left_anti"), "questions")
    waves = -(-questions.count() // wave_rows)
    wave_of = F.pmod(F.xxhash64("digest"), F.lit(max(waves, 1)))
    for wave in range(waves):
        store.commit(batch_score(
            questions.where(wave_of == wave), load, score, model_key=(model, json.dumps(settings or {}, sort_keys=True)),
            prompt=_SEEN, batch_size=batch_size, prompt_limit=None,
        ))
    answers = store.answers().select(F.col("digest").alias(_DIGEST), F.col("response").alias(response), "error")
    return rows.join(answers, _DIGEST, "left").drop(_DIGEST)
