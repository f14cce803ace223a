"""Templating as table operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from loomset.functions import chat
from loomset.schema import Kind

_SALTS = 16


def format_examples(df: DataFrame, kind: Kind, *keep: str, template: str | None = None,
                    system_prompt: str = chat.SYSTEM_PROMPT) -> DataFrame:
    return df.select(*keep, chat.format_example(kind, template, system_prompt).alias("text"))


def render_turns(df: DataFrame, turn: str, role: str, content: str, template: str | Sequence[str], *chat_key: str) -> DataFrame:
    """(chat_key..., turn, rendered): marked-up text per turn of multi-turn chats, one row per turn.

    Joining a chat's rows in turn order gives its full rendering, as ``chat.render`` makes it of
    the message list; it is left in pieces so that no chat, however long, has to fit one task.
    With several templates each has a column of its name. Families without a system role fold
    a leading system text into the user turn that follows: the system turn then has only the
    begin mark. First and last turns come from partial aggregates and are joined back with
    long chats spread over ``_SALTS`` parts. (chat_key, turn) is unique; a key may be NULL, which
    counts as a chat; NULL contents are empty.
    """
    names = [template] if isinstance(template, str) else list(template)
    keys = [f"_key{i}" for i in range(len(chat_key))]
    rows = df.select(
        *[F.col(c).alias(k) for c, k in zip(chat_key, keys)], F.col(turn).alias("_turn"), F.col(role).alias("_role"),
        F.coalesce(F.col(content), F.lit("")).alias("_content"),
    )
    head_text = F.when(F.col("_role") == "system", F.col("_content"))
    edges = rows.groupBy(*keys).agg(
        F.min(F.struct("_turn", head_text.alias("system"))).alias("_head"), F.max("_turn").alias("_last")
    )
    known = _per_chat(rows, edges, keys)
    folding = any(chat.TEMPLATES[n].fold_system for n in names)
    if folding:
        later = known.where((F.col("_turn") > F.col("_head._turn")) & F.col("_head.system").isNotNull())
        known = _per_chat(known, later.groupBy(*keys).agg(F.min("_turn").alias("_second")), keys)
    is_head = F.col("_turn") == F.col("_head._turn")
    folded = is_head & F.col("_head.system").isNotNull() & (F.col("_last") > F.col("_turn"))
    takes = (F.col("_turn") == F.col("_second")) & (F.col("_role") == "user") if folding else None

    def piece(name: str) -> Column:
        t = chat.TEMPLATES[name]
        if t.fold_system:
            body = F.when(takes, F.concat("_head.system", F.lit("\n\n"), "_content")).otherwise(F.col("_content"))
            text = F.when(folded, "").otherwise(chat.turn_text(F.col("_role"), body, name))
        else:
            text = chat.turn_text(F.col("_role"), F.col("_content"), name)
        begin, end = F.when(is_head, t.begin).otherwise(""), F.when(F.col("_turn") == F.col("_last"), t.end).otherwise("")
        return F.concat(begin, text, end)

    out = [piece(n).alias("rendered" if isinstance(template, str) else n) for n in names]
    return known.select(*[F.col(k).alias(c) for c, k in zip(chat_key, keys)], F.col("_turn").alias(turn), *out)


def _per_chat(rows: DataFrame, chats: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their chat's row in ``chats``, NULL if it has none."""
    salt = F.pmod(F.xxhash64("_turn"), F.lit(_SALTS)).cast("int")
    each = chats.select(
        *[F.col(k).alias(f"{k}_") for k in keys], *[c for c in chats.columns if c not in keys],
        F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt_"),
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.col("_salt") == F.col("_salt_"))
    return rows.withColumn("_salt", salt).join(each, same, "left").drop("_salt", "_salt_", *[f"{k}_" for k in keys])


def whole_chats(pieces: DataFrame, turn: str, *chat_key: str) -> DataFrame:
    """(chat_key..., columns): the pieces of :func:`render_turns` joined in turn order, a row per chat.

    Only for chats that fit a row.
    """
    texts = [c for c in pieces.columns if c not in (turn, *chat_key)]
    ordered = F.sort_array(F.collect_list(F.struct(turn, *texts))).alias("_pieces")
    return pieces.groupBy(*chat_key).agg(ordered).select(
        *chat_key, *[F.array_join(F.col(f"_pieces.{c}"), "").alias(c) for c in texts]
    )


def judge_prompts(df: DataFrame, *keep: str, prompt: str = "prompt", response: str = "response",
                  criteria: tuple[str, ...] = chat.JUDGE_CRITERIA) -> DataFrame:
    """One judge prompt per row and criterion."""
    each = df.withColumn("criterion", F.explode(F.array(*[F.lit(c) for c in criteria])))
    return each.select(
        *keep, "criterion",
        chat.judge_prompt(F.col("criterion"), F.col(prompt), F.col(response)).alias("judge_prompt"),
    )
