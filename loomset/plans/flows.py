"""The end-to-end flows: look at a file, prepare it for training, evaluate predictions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomset.functions.chat import JUDGE_CRITERIA, format_example
from loomset.operators.augment import augment
from loomset.operators.batching import with_ordinal
from loomset.operators.clean import drop_empty, quality_filter, quality_report, validation_report
from loomset.operators.embedding import complete_matches, embedding_match, match_report, token_vectors
from loomset.operators.encode import MAX_LENGTH, PREFERENCE_MAX_LENGTH, build_vocab, encode, encode_preference
from loomset.operators.metrics import assemble_results, metric_report, score_rows
from loomset.operators.preview import preview_or_status
from loomset.operators.projection import UnmappedColumns, require_kind
from loomset.operators.scoring import batch_score, judge
from loomset.operators.split import with_split
from loomset.operators.stats import dataset_stats
from loomset.runtime import materialise
from loomset.schema import CHOSEN, Kind, REJECTED
from loomset.sinks.writers import write_card, write_csv, write_split
from loomset.sources.readers import read_eval, read_examples, read_prompts

Load = Callable[[], Any]
Score = Callable[[Any, list[str]], list[str]]
Embed = Callable[[Any, str], list[list[float]]]


@dataclass
class Inspection:
    kind: Kind
    examples: DataFrame
    issues: DataFrame
    stats: DataFrame

    def preview(self, order: str) -> DataFrame:
        return preview_or_status(self.examples, self.kind, order)


@dataclass
class MappingNeeded:
    """A file whose columns imply no kind: pick some of ``columns`` and pass them as ``mapping``."""

    columns: list[str]


def inspect(spark: SparkSession, path: str, preference: bool = False, **reading) -> Inspection | MappingNeeded:
    """Read, resolve, clean; issues and statistics are lazy and come from one scan each."""
    try:
        raw, kind = read_examples(spark, path, preference=preference, **reading)
    except UnmappedColumns as unmapped:
        return MappingNeeded(unmapped.columns)
    cleaned = drop_empty(raw, kind)
    return Inspection(kind, cleaned, validation_report(raw, kind), dataset_stats(cleaned, kind))


def prepare(examples: DataFrame, kind: Kind, key: str, out: str, vocab_size: int,
            max_length: int = MAX_LENGTH, template: str | None = None, lengths: tuple[int, int] | None = None,
            augmenting: dict[str, Any] | None = None) -> DataFrame | None:
    """clean -> filter -> augment -> template -> vocabulary -> encode -> exact split -> Parquet and card.

    ``lengths`` (low, high) turns the filter on; its report (original, removed, remaining) is
    returned. ``augmenting`` holds the arguments of ``augment``; the copies of an example share
    its key, so that all of them are on one side of the split.
    """
    cleaned = drop_empty(examples, kind)
    report = None
    if lengths is not None:
        report = materialise(quality_report(cleaned, kind, *lengths), "filter-report")
        cleaned = quality_filter(cleaned, kind, *lengths)
    rows = cleaned if augmenting is None else augment(cleaned, kind, key, **augmenting)
    text = materialise(rows.select(key, format_example(kind, template).alias("text")), "formatted")
    vocab = materialise(build_vocab(text, "text", size=vocab_size), "vocab")
    encoded = encode(text, key, "text", vocab, max_length)
    if augmenting is None:
        labelled = with_split(materialise(encoded, "encoded"), key)
    else:
        sides = with_split(cleaned.select(key), key).select(F.col(key).alias("_key"), "split").distinct()
        labelled = encoded.join(sides, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    write_split(labelled, f"{out}/examples")
    vocab.write.parquet(f"{out}/vocab")
    write_card(cleaned, kind, f"{out}/card", examples)
    return report


def prepare_preferences(examples: DataFrame, key: str, out: str, vocab_size: int | None = None,
                        max_length: int = PREFERENCE_MAX_LENGTH) -> None:
    """clean -> exact split -> Parquet and card; encoded too, for reward models, if ``vocab_size`` is given.

    Without a ``prompt`` column the examples are of the reward kind.
    """
    kind = require_kind(examples.columns, preference=True)
    cleaned = drop_empty(examples, kind)
    rows = cleaned
    if vocab_size is not None:
        vocab = materialise(build_vocab(cleaned, CHOSEN, REJECTED, size=vocab_size), "vocab")
        vocab.write.parquet(f"{out}/vocab")
        rows = materialise(encode_preference(cleaned, key, vocab, max_length), "encoded")
    write_split(with_split(rows, key), f"{out}/examples")
    write_card(cleaned, kind, f"{out}/card", examples)


def with_row_id(df: DataFrame, *order: str) -> DataFrame:
    """A ``row_id`` for tables without one, by the unique ``order`` columns."""
    return with_ordinal(df, *order, name="row_id")


def evaluate(eval_rows: DataFrame, predictions: DataFrame, key: str,
             judgments: DataFrame | None = None, stem: bool = True,
             embed_with: tuple[Load, Embed] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(metric report, result table); without references there is no report.

    ``embed_with``, a model that gives a text's token vectors, adds the embedding metrics.
    """
    prompts = eval_rows.select(key, "prompt")
    references = eval_rows.select(key, "reference") if "reference" in eval_rows.columns else None
    results = assemble_results(prompts, predictions.select(key, "prediction"), key, references, judgments)
    if references is None:
        return None, results
    scored = score_rows(results.where(F.col("reference").isNotNull()), key, stem=stem, deal=True)
    report = metric_report(scored)
    if embed_with is not None:
        pairs = results.where(F.col("reference").isNotNull())
        vectors = materialise(token_vectors(pairs, key, *embed_with), "vectors")
        report = report.unionByName(match_report(complete_matches(embedding_match(vectors), pairs.select(key), key)))
    return report, results


def answer_file(spark: SparkSession, path: str, out: str, load: Load, score: Score, **options) -> DataFrame:
    """Prompt file -> (prompt, response) CSV. A prompt that fails has its error as response."""
    scored = batch_score(read_prompts(spark, path), load, score, **options)
    rows = scored.select("prompt", F.coalesce("response", "error").alias("response"))
    write_csv(rows, out)
    return spark.read.schema(rows.schema).options(header=True, multiLine=True, escape='"').csv(out)


def evaluate_file(spark: SparkSession, path: str, load: Load, score: Score,
                  judge_with: tuple[Load, Score] | None = None, criteria: str = JUDGE_CRITERIA[0],
                  embed_with: tuple[Load, Embed] | None = None, **options) -> tuple[DataFrame | None, DataFrame]:
    """Evaluation file -> (metric report, result table), optionally with a judge's verdicts and embedding metrics.

    Model answers are written once before metrics, judge and table read them.
    """
    rows = read_eval(spark, path).withColumn("row_id", F.monotonically_increasing_id())
    scored = batch_score(rows, load, score, response="answer", **options)
    answered = materialise(
        scored.select("row_id", "prompt", "reference", F.coalesce("answer", "error").alias("prediction")), "answers"
    )
    judgments = None
    if judge_with is not None:
        verdicts = judge(answered, "row_id", *judge_with, criteria=(criteria,), response="prediction")
        judgments = verdicts.select("row_id", F.coalesce("judgment", "error").alias("judgment"))
    has_references = answered.where(F.col("reference").isNotNull()).limit(1).count() > 0
    eval_rows = answered.select("row_id", "prompt", *(["reference"] if has_references else []))
    return evaluate(eval_rows, answered, "row_id", judgments, embed_with=embed_with)
