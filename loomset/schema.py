"""Column vocabulary and the table shapes every operator understands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Column names the accepted files use.
INSTRUCTION = "instruction"
OUTPUT = "output"
TEXT = "text"
PROMPT = "prompt"
CHOSEN = "chosen"
REJECTED = "rejected"
REFERENCE = "reference"
PREDICTION = "prediction"
JUDGMENT = "judgment"
RESPONSE = "response"

# The length bounds used across validation and filtering.
OVER_LENGTH = 2048
QUALITY_MIN = 50
QUALITY_MAX = 2048


@dataclass(frozen=True)
class Kind:
    """A table shape: its name, its columns and how many rows a preview shows."""

    name: str
    columns: tuple[str, ...]
    preview_rows: int

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.columns])


PREFERENCE_KIND = Kind("preference", (PROMPT, CHOSEN, REJECTED), 5)
REWARD_KIND = Kind("reward", (CHOSEN, REJECTED), 5)
INSTRUCTION_KIND = Kind("instruction", (INSTRUCTION, OUTPUT), 5)
TEXT_KIND = Kind("text", (TEXT,), 10)
KINDS = {k.name: k for k in (PREFERENCE_KIND, REWARD_KIND, INSTRUCTION_KIND, TEXT_KIND)}

MESSAGES_TYPE = "array<struct<role:string,content:string>>"
