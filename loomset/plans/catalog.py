"""The registered queries: each runs one operator over whole tables of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomset.functions import chat
from loomset.functions.text import first_tokens, tokens
from loomset.operators import (
    answers, augment, batching, chatting, clean, embedding, encode, losses, metrics, preview, projection, pruned,
    scoring, split, stats,
)
from loomset.plans import exports, fixtures as fx
from loomset.runtime import scratch_path
from loomset.schema import INSTRUCTION_KIND, Kind, PREFERENCE_KIND, TEXT_KIND
from loomset.sinks import writers
from loomset.sources import formats, ranges, readers
from loomset.streaming import stopping, streams, upserts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VOCAB_SIZE = 1000
VERSIONS = ("1.0", "1.10", "1.2")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _by_kind(spark: SparkSession, sf: str, blanked: bool = False) -> list[tuple[Kind, str, DataFrame]]:
    docs, pairs, prefs = (
        (fx.documents_blanked, fx.pairs_blanked, fx.prefs_blanked)
        if blanked
        else (fx.documents, fx.conv_pairs, fx.conv_prefs)
    )
    return [
        (TEXT_KIND, "doc_id", docs(spark, sf)),
        (INSTRUCTION_KIND, "row_id", pairs(spark, sf)),
        (PREFERENCE_KIND, "row_id", prefs(spark, sf)),
    ]


def _csv(array: str) -> Column:
    return F.array_join(F.col(array).cast("array<string>"), ",").alias(array)


# --- sources


@query
def src_format_route(spark, sf):
    suffixes = F.array(*[F.lit(s) for s in (".csv", ".jsonl", ".json", ".txt", ".xlsx", ".pdf", ".zip", ".CSV", "")])
    path = F.concat(
        F.lit("/data/"), "source", F.lit("/Doc"), F.col("doc_id").cast("string"),
        F.get(suffixes, (F.col("doc_id") % 9).cast("int")),
    )
    docs = fx.table(spark, sf, "documents").select("doc_id", path.alias("path"))
    return docs.select("doc_id", "path", formats.format_of(F.col("path")).alias("format"))


@query
def src_csv(spark, sf):
    path = exports.csv_export(fx.documents(spark, sf))
    return readers.read_csv(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


@query
def src_csv_by_name(spark, sf):
    """Columns asked for in another order than the header has them."""
    path = exports.csv_export(fx.conv_pairs(spark, sf))
    rows = readers.read_csv(spark, path, "output", "row_id", "instruction")
    return rows.withColumn("row_id", F.col("row_id").cast("long"))


@query
def src_csv_ranges(spark, sf):
    """Files cut into ranges of bytes, quoted line breaks and all."""
    path = exports.csv_export(fx.documents(spark, sf))
    return ranges.read_csv_ranges(spark, path, "text", "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))


@query
def src_json_array_ranges(spark, sf):
    path = exports.json_array_export(fx.conv_prefs(spark, sf))
    rows = ranges.read_json_array_ranges(spark, path, "row_id", "prompt", "chosen", "rejected")
    return rows.withColumn("row_id", F.col("row_id").cast("long"))


@query
def src_jsonl(spark, sf):
    path = exports.jsonl_export(fx.conv_pairs(spark, sf))
    rows = readers.read_jsonl(spark, path, "row_id", "instruction", "output")
    return rows.withColumn("row_id", F.col("row_id").cast("long"))


@query
def src_json_array(spark, sf):
    path = exports.json_array_export(fx.conv_prefs(spark, sf))
    rows = readers.read_json_array(spark, path, "row_id", "prompt", "chosen", "rejected")
    return rows.withColumn("row_id", F.col("row_id").cast("long"))


@query
def src_text_lines(spark, sf):
    return readers.read_text_lines(spark, exports.text_export(fx.documents(spark, sf), "text"))


@query
def src_paragraphs(spark, sf):
    return readers.split_paragraphs(fx.paragraph_texts(spark, sf), "text", "doc_id")


@query
def src_prompts(spark, sf):
    prompts = fx.conv_pairs(spark, sf).select("row_id", F.col("instruction").alias("prompt"))
    return readers.read_prompts(spark, exports.csv_export(prompts), "csv")


@query
def src_prompt_lines(spark, sf):
    path = exports.text_export(fx.conv_pairs(spark, sf), "instruction")
    return readers.read_prompts(spark, path, "txt").select("prompt")


@query
def src_eval(spark, sf):
    rows = fx.eval_pairs(spark, sf).select("row_id", "prompt", "reference")
    got = readers.read_eval(spark, exports.jsonl_export(rows), "row_id", fmt="jsonl")
    return got.withColumn("row_id", F.col("row_id").cast("long"))


@query
def src_eval_mixed(spark, sf):
    """Files whose headers have the columns in different orders, and one of them one column more."""
    rows = fx.eval_pairs(spark, sf).select("row_id", "prompt", "reference", "prediction")
    folder = scratch_path(spark, "mixed")
    first = F.length("prompt") < F.length("reference")
    writers.write_csv(rows.where(first).select("reference", "row_id", "prompt"), f"{folder}/one")
    writers.write_csv(rows.where(~first).select("row_id", "prediction", "prompt", "reference"), f"{folder}/two")
    got = readers.read_eval(spark, f"{folder}/*", "row_id", fmt="csv", ranges=True)
    return got.withColumn("row_id", F.col("row_id").cast("long"))


# --- projection


@query
def proj_map_columns(spark, sf):
    odd = fx.conv_pairs(spark, sf).withColumnsRenamed({"instruction": "question", "output": "answer"})
    return projection.map_columns(odd, projection.build_mapping("question", "answer", None))


@query
def proj_schema_kind(spark, sf):
    pairs = fx.conv_pairs(spark, sf)
    tables = [
        ("documents", fx.documents(spark, sf), False),
        ("pairs", pairs, False),
        ("pairs_and_text", pairs.withColumn("text", F.col("instruction")), False),
        ("preferences", fx.conv_prefs(spark, sf), True),
        ("preferences_as_sft", fx.conv_prefs(spark, sf), False),
    ]

    def resolved(name, df, preference):
        kind = projection.resolve_kind(df.columns, preference)
        return df.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("name"), F.lit(kind.name if kind else "unmapped").alias("kind"), "n"
        )

    return _all([resolved(*t) for t in tables])


@query
def proj_stringify(spark, sf):
    typed = fx.table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("instruction"), F.expr("nullif(toxic, 1)").alias("output")
    )
    return projection.stringify(typed, INSTRUCTION_KIND, "doc_id", null_token="nan")


@query
def proj_prompt(spark, sf):
    return projection.resolve_prompt(fx.documents(spark, sf))


# --- validation and filters


def _lengths(position: int) -> Query:
    def run(spark, sf):
        kind, key, df = _by_kind(spark, sf)[position]
        return clean.with_length(df, kind).select(key, "n")

    return run


def _kept(position: int, **options) -> Query:
    def run(spark, sf):
        kind, key, df = _by_kind(spark, sf, blanked=True)[position]
        return clean.drop_empty(df, kind, **options).select(key)

    return run


def _good(position: int) -> Query:
    def run(spark, sf):
        kind, key, df = _by_kind(spark, sf)[position]
        return clean.quality_filter(df, kind).select(key)

    return run


for _i, _name in enumerate(("text", "instruction", "preference")):
    QUERIES[f"len_{_name}"] = _lengths(_i)
    QUERIES[f"drop_empty_{_name}"] = _kept(_i)
    QUERIES[f"quality_{_name}"] = _good(_i)
QUERIES["drop_empty_preference_compat"] = _kept(2, compat=True)


@query
def drop_empty_preference_gate_shut(spark, sf):
    """No row lacks all fields, so that the older rule keeps those that lack some."""
    some = fx.prefs_blanked(spark, sf).where("length(prompt) + length(chosen) + length(rejected) > 0")
    return clean.drop_empty(some, PREFERENCE_KIND, compat=True).select("row_id")


@query
def over_length(spark, sf):
    count = clean.over_length_count(fx.documents(spark, sf), TEXT_KIND)
    return count.select(F.lit("over_length").alias("issue"), "n")


@query
def over_length_rows(spark, sf):
    return clean.flag_over_length(fx.documents(spark, sf), TEXT_KIND).select("doc_id", "over_length")


@query
def validation_report(spark, sf):
    return _all([
        clean.validation_report(df, kind).withColumn("kind", F.lit(kind.name))
        for kind, _, df in _by_kind(spark, sf, blanked=True)
    ])


@query
def quality_report(spark, sf):
    return _all([
        clean.quality_report(df, kind).withColumn("kind", F.lit(kind.name))
        for kind, _, df in _by_kind(spark, sf)
    ])


# --- summaries, previews, splits, batches


@query
def dataset_stats(spark, sf):
    return _all([stats.dataset_stats(df, kind) for kind, _, df in _by_kind(spark, sf)])


@query
def length_stats(spark, sf):
    return _all([
        stats.length_stats(df, kind).withColumn("kind", F.lit(kind.name)) for kind, _, df in _by_kind(spark, sf)
    ])


@query
def quality_by_language(spark, sf):
    """The first slice end to end: clean, filter by length, profile per language."""
    docs = fx.table(spark, sf, "documents").select("lang", "text")
    kept = clean.quality_filter(clean.drop_empty(docs, TEXT_KIND), TEXT_KIND)
    return stats.length_stats(kept, TEXT_KIND, "lang")


@query
def preview_head(spark, sf):
    return preview.preview(fx.documents(spark, sf), TEXT_KIND, "doc_id")


@query
def preview_formatted(spark, sf):
    return _all([
        preview.preview_formatted(df, kind, key).select(F.col(key).alias("id"), "preview", F.lit(kind.name).alias("kind"))
        for kind, key, df in _by_kind(spark, sf)
    ])


@query
def split_train_test(spark, sf):
    return split.with_split(fx.documents(spark, sf), "doc_id").select("doc_id", "split")


@query
def split_sizes(spark, sf):
    return split.split_sizes(split.with_split(fx.documents(spark, sf), "doc_id"))


@query
def split_null_keys(spark, sf):
    """One row without a key is a key like others."""
    docs = fx.documents(spark, sf).withColumn("doc_id", F.expr("nullif(doc_id, 0)"))
    return split.split_sizes(split.with_split(docs, "doc_id"))


@query
def batch_assign(spark, sf):
    return batching.assign_batches(fx.conv_pairs(spark, sf), "row_id").select("row_id", "batch_id")


# --- templates


@query
def fmt_instruction(spark, sf):
    return chatting.format_examples(fx.conv_pairs(spark, sf), INSTRUCTION_KIND, "row_id")


@query
def fmt_text(spark, sf):
    return chatting.format_examples(fx.documents(spark, sf), TEXT_KIND, "doc_id")


@query
def chat_messages(spark, sf):
    return fx.conv_pairs(spark, sf).select("row_id", F.to_json(chat.messages(INSTRUCTION_KIND)).alias("messages"))


@query
def chat_messages_text(spark, sf):
    return fx.documents(spark, sf).select("doc_id", F.to_json(chat.messages(TEXT_KIND)).alias("messages"))


@query
def chat_render(spark, sf):
    pairs = fx.conv_pairs(spark, sf)
    return pairs.select("row_id", *[chat.format_example(INSTRUCTION_KIND, t).alias(t) for t in chat.TEMPLATES])


@query
def chat_render_conversation(spark, sf):
    turns = fx.table(spark, sf, "conversations")
    return chatting.render_turns(turns, "turn", "role", "text", list(chat.TEMPLATES), "conv_id")


@query
def chat_render_whole(spark, sf):
    turns = fx.table(spark, sf, "conversations")
    pieces = chatting.render_turns(turns, "turn", "role", "text", list(chat.TEMPLATES), "conv_id")
    return chatting.whole_chats(pieces, "turn", "conv_id")


@query
def judge_prompts(spark, sf):
    return chatting.judge_prompts(fx.eval_pairs(spark, sf), "row_id", response="prediction")


# --- vocabulary and encoding


def _formatted(spark, sf) -> DataFrame:
    return chatting.format_examples(fx.conv_pairs(spark, sf), INSTRUCTION_KIND, "row_id")


def _vocab(texts: DataFrame, *columns: str) -> DataFrame:
    return encode.build_vocab(texts, *columns, size=VOCAB_SIZE)


@query
def vocab_build(spark, sf):
    return _vocab(fx.heavy_documents(spark, sf), "text")


@query
def vocab_heavy(spark, sf):
    """As ``vocab_build``, from summaries of the tasks and an exact recount."""
    return encode.heavy_vocab(fx.heavy_documents(spark, sf), "text", size=VOCAB_SIZE)


@query
def encode_pad(spark, sf):
    texts = _formatted(spark, sf)
    rows = encode.encode(texts, "row_id", "text", _vocab(texts, "text"))
    return rows.select("row_id", _csv("input_ids"), _csv("attention_mask"))


@query
def encode_documents(spark, sf):
    """The encoder over whole documents, longer than the context on average."""
    docs = fx.heavy_documents(spark, sf)
    rows = encode.encode(docs, "doc_id", "text", _vocab(docs, "text"))
    return rows.select("doc_id", _csv("input_ids"))


@query
def encode_labels(spark, sf):
    texts = _formatted(spark, sf)
    return encode.encode(texts, "row_id", "text", _vocab(texts, "text")).select("row_id", _csv("labels"))


@query
def encode_preference(spark, sf):
    prefs = fx.conv_prefs(spark, sf)
    rows = encode.encode_preference(prefs, "row_id", _vocab(prefs, "chosen", "rejected"))
    return rows.select("row_id", *[_csv(c) for c in rows.columns if c != "row_id"])


@query
def encode_documents_joined(spark, sf):
    """As ``encode_documents`` where the vocabulary is joined, as one of any size is."""
    docs = fx.documents(spark, sf)
    rows = encode.encode(docs, "doc_id", "text", _vocab(docs, "text"), inline_limit=0)
    return rows.select("doc_id", _csv("input_ids"))


@query
def encode_preference_joined(spark, sf):
    prefs = fx.conv_prefs(spark, sf)
    rows = encode.encode_preference(prefs, "row_id", _vocab(prefs, "chosen", "rejected"), inline_limit=0)
    return rows.select("row_id", *[_csv(c) for c in rows.columns if c != "row_id"])


@query
def truncate_tokens(spark, sf):
    return fx.heavy_documents(spark, sf).select("doc_id", first_tokens("text", encode.MAX_LENGTH).alias("text"))


# --- augmentation


def _lexicon(spark, sf, change) -> DataFrame:
    """All words of the documents with a made-up replacement each."""
    words = fx.heavy_documents(spark, sf).select(F.explode_outer(tokens("text")).alias("word")).where("word is not null").distinct()
    return words.withColumn("replacement", change(F.col("word")))


@query
def augment_replicate(spark, sf):
    return augment.replicate(fx.documents(spark, sf), 3).select("doc_id", "copy_no", "text")


@query
def augment_report(spark, sf):
    return augment.augment_report(augment.replicate(fx.documents(spark, sf), 3))


@query
def augment_synonym(spark, sf):
    lexicon = _lexicon(spark, sf, lambda w: F.concat(F.lit("syn:"), w))
    return augment.augment(fx.heavy_documents(spark, sf), TEXT_KIND, "doc_id", 2, "synonym", lexicon)


@query
def augment_synonym_joined(spark, sf):
    """As ``augment_synonym`` where the lexicon is joined, as one of any size is."""
    docs = fx.documents(spark, sf)
    lexicon = _lexicon(spark, sf, lambda w: F.concat(F.lit("syn:"), w))
    return augment.augment(docs, TEXT_KIND, "doc_id", 2, "synonym", lexicon, inline_limit=0)


@query
def augment_phrases(spark, sf):
    """Entries of one, three and three words that overlap: the first words of every instruction."""
    pairs = fx.conv_pairs(spark, sf)
    words = tokens("instruction")
    entries = F.array(*[F.array_join(F.slice(words, start, n), " ") for start, n in ((1, 3), (2, 3), (3, 1), (3, 2))])
    lexicon = pairs.select(F.explode(entries).alias("word")).where("word <> ''").distinct()
    lexicon = lexicon.withColumn("replacement", F.concat(F.lit("<"), "word", F.lit(">")))
    return augment.augment(pairs, INSTRUCTION_KIND, "row_id", 2, "synonym", lexicon)


@query
def augment_random_word(spark, sf):
    return augment.augment(fx.heavy_documents(spark, sf), TEXT_KIND, "doc_id", 2, "random_word")


@query
def augment_spelling(spark, sf):
    return augment.augment(fx.conv_pairs(spark, sf), INSTRUCTION_KIND, "row_id", 3, "spelling", _lexicon(spark, sf, F.reverse))


# --- metrics


def _rounded(df: DataFrame, key: str, places: int = 6) -> DataFrame:
    return df.select(key, *[F.round(c, places).alias(c) for c in df.columns if c != key])


@query
def ngram_overlap(spark, sf):
    return metrics.ngram_overlap(fx.eval_pairs(spark, sf), "row_id")


@query
def bleu_rows(spark, sf):
    return _rounded(metrics.score_rows(fx.eval_pairs(spark, sf), "row_id", deal=True, rouge_n=False, rouge_l=False), "row_id")


@query
def rouge_n_rows(spark, sf):
    rows = metrics.score_rows(fx.eval_pairs(spark, sf), "row_id", deal=True, bleu=False, rouge_l=False, stem=False)
    return _rounded(rows, "row_id")


@query
def rouge_l_rows(spark, sf):
    rows = metrics.score_rows(fx.eval_pairs(spark, sf), "row_id", deal=True, bleu=False, rouge_n=False, stem=False)
    return _rounded(rows, "row_id")


@query
def rouge_stemmed(spark, sf):
    return _rounded(metrics.score_rows(fx.eval_pairs(spark, sf), "row_id", deal=True, bleu=False), "row_id")


@query
def eval_metrics(spark, sf):
    return metrics.metric_report(metrics.score_rows(fx.eval_pairs(spark, sf), "row_id", deal=True))


@query
def eval_results(spark, sf):
    rows = fx.eval_pairs(spark, sf)
    judged = rows.select("row_id", F.concat(F.length("prediction").cast("string"), F.lit(" chars")).alias("judgment"))
    return metrics.assemble_results(
        rows.select("row_id", "prompt"), rows.where("prediction <> ''").select("row_id", "prediction"), "row_id",
        rows.select("row_id", "reference"), judged,
    )


@query
def embedding_match(spark, sf):
    return _rounded(embedding.embedding_match(fx.emb_pairs(spark, sf)), "pair_id")


@query
def embedding_match_pruned(spark, sf):
    return _rounded(pruned.embedding_match_pruned(fx.emb_groups(spark, sf), 16), "pair_id")


@query
def embedding_report(spark, sf):
    return embedding.match_report(embedding.embedding_match(fx.emb_pairs(spark, sf)))


# --- scoring with a stand-in model


def _load_stub():
    return "{n} chars: {prompt}"


def _score_stub(model, prompts):
    return [model.format(n=len(p), prompt=p) for p in prompts]


def _score_fussy(model, prompts):
    if any("que" in p for p in prompts):
        raise ValueError("cannot answer")
    return _score_stub(model, prompts)


def _score_judge(model, prompts):
    return [f"  {1 + len(p) % 10} of 10  " for p in prompts]


@query
def batch_score(spark, sf):
    prompts = fx.eval_pairs(spark, sf).select("row_id", "prompt")
    return scoring.batch_score(prompts, _load_stub, _score_stub)


@query
def batch_score_errors(spark, sf):
    prompts = fx.eval_pairs(spark, sf).select("row_id", "prompt")
    return scoring.batch_score(prompts, _load_stub, _score_fussy)


@query
def batch_score_resumed(spark, sf):
    """Short prompts are scored first, then all, of which the store has the short ones."""
    prompts = fx.eval_pairs(spark, sf).select("row_id", "prompt")
    store = scratch_path(spark, "answers")
    score = lambda rows: answers.resumed_score(rows, store, _load_stub, _score_stub, "stub", {"temperature": 0})
    score(prompts.where("length(prompt) < 400"))
    return score(prompts)


@query
def judge_run(spark, sf):
    rows = fx.eval_pairs(spark, sf)
    return scoring.judge(rows, "row_id", _load_stub, _score_judge, response="prediction")


# --- training logs


@query
def loss_log(spark, sf):
    return losses.loss_log(fx.train_logs(spark, sf))


@query
def loss_log_nan(spark, sf):
    """Logs with NaN where a loss is absent."""
    logs = fx.train_logs(spark, sf)
    absent = {c: F.coalesce(c, F.lit(float("nan"))) for c in ("train_loss", "eval_loss")}
    return losses.loss_log(logs.withColumns(absent))


@query
def loss_curve(spark, sf):
    return losses.loss_curve(fx.train_logs(spark, sf))


@query
def final_loss(spark, sf):
    return losses.final_loss(fx.train_logs(spark, sf))


@query
def early_stop_step(spark, sf):
    return losses.early_stop_step(fx.train_logs(spark, sf))


@query
def early_stop_nan(spark, sf):
    """Logs with NaN where a loss is absent."""
    logs = fx.train_logs(spark, sf)
    return losses.early_stop_step(logs.withColumn("eval_loss", F.coalesce("eval_loss", F.lit(float("nan")))))


@query
def best_step(spark, sf):
    return losses.best_step(fx.train_logs(spark, sf))


# --- sinks


@query
def sink_csv_roundtrip(spark, sf):
    scored = fx.conv_pairs(spark, sf).select(F.col("instruction").alias("prompt"), F.col("output").alias("response"))
    path = scratch_path(spark, "results.csv")
    writers.write_csv(scored, path)
    return readers.read_csv(spark, path)


@query
def sink_split_roundtrip(spark, sf):
    path = scratch_path(spark, "split")
    writers.write_split(split.with_split(fx.documents(spark, sf), "doc_id"), path)
    return spark.read.parquet(path).select("doc_id", "text", "split")


@query
def dataset_card(spark, sf):
    return writers.dataset_card(fx.documents(spark, sf), TEXT_KIND)


@query
def card_issues(spark, sf):
    """The written card of a cleaned table, with what cleaning took from the raw one."""
    raw = fx.pairs_blanked(spark, sf)
    path = scratch_path(spark, "card")
    writers.write_card(clean.drop_empty(raw, INSTRUCTION_KIND), INSTRUCTION_KIND, path, raw)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def registry_load(spark, sf):
    """A version's rows, found through its metadata."""
    registry = writers.DatasetRegistry(spark, scratch_path(spark, "registry"))
    for version, low in (("1.0", 0), ("2.0", 1000)):
        registry.publish(clean.quality_filter(fx.documents(spark, sf), TEXT_KIND, low, 1 << 30), version, {"licence": "own"})
    return registry.load("2.0").select("doc_id")


@query
def registry_publish(spark, sf):
    registry = writers.DatasetRegistry(spark, scratch_path(spark, "registry"))
    meta = registry.publish(fx.documents(spark, sf), " 1.0 ", {"notes": "first"})
    return meta.select(
        "base_model", "notes", "version", "num_examples", F.col("uploaded_at").isNotNull().alias("stamped")
    )


@query
def registry_list(spark, sf):
    registry = writers.DatasetRegistry(spark, scratch_path(spark, "registry"))
    for version in VERSIONS:
        registry.publish(fx.conv_pairs(spark, sf), version)
    return registry.list_versions()


@query
def registry_replay(spark, sf):
    """A version that is withdrawn and published anew, and one that is withdrawn for good."""
    registry = writers.DatasetRegistry(spark, scratch_path(spark, "registry"))
    for version, table in (("1.0", "documents"), ("2.0", "documents")):
        registry.publish(fx.table(spark, sf, table), version)
        registry.withdraw(version)
    registry.publish(fx.conv_pairs(spark, sf), "1.0")
    return registry.list_versions()


# --- streams


@query
def stream_clean_format(spark, sf):
    schema = fx.documents(spark, sf).schema
    docs = streams.stream_parquet(spark, sf, schema, "documents.parquet")
    return _drained(streams.clean_and_format(docs, TEXT_KIND, "doc_id", template="chatml"))


@query
def stream_loss_window(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    events = streams.stream_parquet(spark, sf, schema, "events.parquet")
    return _drained(streams.loss_windows(fx.as_train_logs(events)))


@query
def stream_loss_window_all(spark, sf):
    """Bounded input drained to its end: open windows too."""
    schema = fx.table(spark, sf, "events").schema
    windows = streams.loss_windows(fx.as_train_logs(streams.stream_parquet(spark, sf, schema, "events.parquet")))
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    streams.run_to_end(windows, out, state)
    return spark.read.schema(windows.schema).parquet(out)


@query
def stream_loss_nan(spark, sf):
    """Logs with NaN where a loss is absent."""
    events = streams.stream_parquet(spark, sf, fx.table(spark, sf, "events").schema, "events.parquet")
    logs = fx.as_train_logs(events)
    return _drained(streams.loss_windows(logs.withColumn("train_loss", F.coalesce("train_loss", F.lit(float("nan"))))))


@query
def stream_loss_upsert(spark, sf):
    """Every record twice, and every batch of windows put in place twice."""
    logs = fx.train_logs(spark, sf)
    folder = scratch_path(spark, "logs")
    logs.unionByName(logs).write.parquet(folder)
    chart = streams.loss_chart(streams.stream_parquet(spark, folder, logs.schema))
    table = upserts.UpsertTable(spark, scratch_path(spark, "chart"), chart.schema, ["run_id", "window_start"], "day")

    class Replayed:
        def upsert(self, batch, number):
            table.upsert(batch, number)
            table.upsert(batch, number)

    upserts.run_upserts(chart, Replayed(), scratch_path(spark, "stream-state"))
    return table.read().drop("day")


@query
def stream_early_stop(spark, sf):
    logs = fx.train_logs(spark, sf)
    folder = scratch_path(spark, "logs")
    logs.write.parquet(folder)
    stopping.closing(logs).write.mode("append").parquet(folder)
    return _drained(stopping.early_stops(streams.stream_parquet(spark, folder, logs.schema)))


def _drained(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    streams.run_available(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)
