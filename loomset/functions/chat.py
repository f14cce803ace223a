"""Prompt templates: plain text, message lists and chat mark-up."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from loomset.functions.text import strip
from loomset.schema import INSTRUCTION, INSTRUCTION_KIND, Kind, MESSAGES_TYPE, OUTPUT, TEXT

# Default system prompt, plain training text, judge criteria and judge prompt.
SYSTEM_PROMPT = "You are a helpful, respectful and honest assistant."
PLAIN_INSTRUCTION = "### Instruction:\n"
PLAIN_RESPONSE = "\n\n### Response:\n"
JUDGE_CRITERIA = ("helpfulness", "accuracy", "coherence", "safety", "relevance")
JUDGE_CRITERION = "Evaluate the following response based on: "
JUDGE_PROMPT = "\n\nPrompt: "
JUDGE_RESPONSE = "\n\nResponse: "
JUDGE_REQUEST = "\n\nScore (1-10) and brief reasoning:"


@dataclass(frozen=True)
class Template:
    """Mark-up of a model family: (prefix, suffix) per role around the content.

    ``fold_system``: the family has no system role, so that text leads the first user turn.
    """

    roles: dict[str, tuple[str, str]] = field(hash=False)
    begin: str = ""
    end: str = ""
    fold_system: bool = False
    strip_content: bool = False


# Published chat mark-up of the model families.
TEMPLATES = {
    "chatml": Template(
        {
            "system": ("<|im_start|>system\n", "<|im_end|>\n"),
            "user": ("<|im_start|>user\n", "<|im_end|>\n"),
            "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n"),
        }
    ),
    "llama3": Template(
        {
            "system": ("<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>"),
            "user": ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>"),
            "assistant": ("<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"),
        },
        begin="<|begin_of_text|>",
        strip_content=True,
    ),
    "mistral": Template(
        {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")},
        begin="<s>",
        fold_system=True,
    ),
    "gemma": Template(
        {
            "user": ("<start_of_turn>user\n", "<end_of_turn>\n"),
            "assistant": ("<start_of_turn>model\n", "<end_of_turn>\n"),
        },
        begin="<bos>",
        fold_system=True,
        strip_content=True,
    ),
    "phi": Template(
        {
            "system": ("<|system|>\n", "<|end|>\n"),
            "user": ("<|user|>\n", "<|end|>\n"),
            "assistant": ("<|assistant|>\n", "<|end|>\n"),
        },
        end="<|endoftext|>",
    ),
}


def plain(kind: Kind) -> Column:
    """Instruction pairs under two headings; text unchanged."""
    if kind is INSTRUCTION_KIND:
        return F.concat(
            F.lit(PLAIN_INSTRUCTION), _text(F.col(INSTRUCTION)), F.lit(PLAIN_RESPONSE), _text(F.col(OUTPUT))
        )
    return F.col(TEXT)


def messages(kind: Kind, system_prompt: str = SYSTEM_PROMPT) -> Column:
    """system, user, assistant for an instruction pair; one user message for text."""
    if kind is INSTRUCTION_KIND:
        turns = [("system", F.lit(system_prompt)), ("user", F.col(INSTRUCTION)), ("assistant", F.col(OUTPUT))]
    else:
        turns = [("user", F.col(TEXT))]
    return F.array(
        *[F.struct(F.lit(r).alias("role"), _text(c).alias("content")) for r, c in turns]
    ).cast(MESSAGES_TYPE)


def render(chat: Column, template: str | None) -> Column:
    """Message list of any length -> marked-up text."""
    t = TEMPLATES[template]
    if t.fold_system:
        chat = _fold_system(chat)
    body = F.array_join(F.transform(chat, lambda m: turn_text(m["role"], m["content"], template)), "")
    return F.concat(F.lit(t.begin), body, F.lit(t.end))


def turn_text(role: Column, content: Column, template: str) -> Column:
    """One message's marked-up text; roles the family does not know read as user turns."""
    t = TEMPLATES[template]
    body = strip(content) if t.strip_content else content

    def wrap(name: str) -> Column:
        prefix, suffix = t.roles[name]
        return F.concat(F.lit(prefix), body, F.lit(suffix))

    shown = F.lit(None).cast("string")
    for name in t.roles:
        if name != "user":
            shown = F.coalesce(shown, F.when(role == name, wrap(name)))
    return F.coalesce(shown, wrap("user"))


def format_example(kind: Kind, template: str | None = None, system_prompt: str = SYSTEM_PROMPT) -> Column:
    """The training text of an example: chat mark-up, or the plain form without a template."""
    return plain(kind) if template is None else render(messages(kind, system_prompt), template)


def judge_prompt(criteria: Column, prompt: Column, response: Column) -> Column:
    return F.concat(
        F.lit(JUDGE_CRITERION), criteria, F.lit(JUDGE_PROMPT), _text(prompt),
        F.lit(JUDGE_RESPONSE), _text(response), F.lit(JUDGE_REQUEST),
    )


def _fold_system(chat: Column) -> Column:
    head = F.get(chat, F.lit(0))
    rest = F.transform(
        F.slice(chat, 2, F.greatest(F.size(chat) - 1, F.lit(0))),
        lambda m, i: F.struct(
            m["role"].alias("role"),
            F.when((i == 0) & (m["role"] == "user"), F.concat(head["content"], F.lit("\n\n"), m["content"]))
            .otherwise(m["content"])
            .alias("content"),
        ),
    )
    return F.when((F.size(chat) > 1) & (head["role"] == "system"), rest).otherwise(chat)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
