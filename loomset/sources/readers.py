"""Files -> string tables in the accepted shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loomset.functions.text import strip
from loomset.operators.projection import SchemaError, map_columns, require_kind, resolve_prompt, stringify
from loomset.schema import Kind, PROMPT, REFERENCE, TEXT
from loomset.sources.formats import UnsupportedFormat, detect_format
from loomset.sources.ranges import read_csv_ranges, read_json_array_ranges


def string_schema(*columns: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, *columns: str, multi_line: bool = True) -> DataFrame:
    """Header, doubled quotes, quoted line breaks; every column a string, empty fields NULL.

    ``columns`` are picked by their names in the header, in whatever order it has them. All files
    of a folder need the same header: one that differs is an error, not a mix of columns.

    Quoted line breaks keep a file from being split: write large data as many files, pass
    ``multi_line=False`` for files without them, or use :func:`loomset.sources.ranges.read_csv_ranges`,
    which also takes each file by its own header.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    header = reader.csv(path).columns
    if missing := [c for c in columns if c not in header]:
        raise SchemaError(f"{path}: no column {', '.join(missing)} in the header {', '.join(header)}")
    rows = reader.option("enforceSchema", False).schema(string_schema(*header)).csv(path)
    return rows.select(*columns) if columns else rows


def read_jsonl(spark: SparkSession, path: str, *columns: str, strict: bool = True) -> DataFrame:
    """One object per line. ``strict`` aborts on a bad line; else it goes to ``_corrupt_record``.

    Name the columns to spare the pass that infers them.
    """
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if columns:
        reader = reader.schema(string_schema(*columns, *(() if strict else ("_corrupt_record",))))
    else:
        reader = reader.option("primitivesAsString", True)
    return reader.json(path)


def read_json_array(spark: SparkSession, path: str, *columns: str, check: bool = True) -> DataFrame:
    """Files holding one top-level array of objects each; anything else is an error."""
    if check:
        _require_arrays(spark, path)
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    reader = reader.schema(string_schema(*columns)) if columns else reader.option("primitivesAsString", True)
    return reader.json(path)


def _require_arrays(spark: SparkSession, path: str) -> None:
    lines = spark.read.text(path).select(
        strip("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("place"),
    )
    first = lines.where("line != ''").groupBy("file").agg(
        F.min_by(F.substring("line", 1, 1), "place").alias("first")
    )
    wrong = first.where("first != '['").select("file").take(1)
    if wrong:
        raise SchemaError(f"{wrong[0]['file']}: expected a top-level array of objects")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): stripped lines that are not blank."""
    return spark.read.text(path).select(strip("value").alias(TEXT)).where(F.col(TEXT) != "")


def split_paragraphs(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep..., pos, text): blocks between blank lines, stripped, blank ones dropped."""
    blocks = df.select(*keep, F.posexplode_outer(F.split(column, "\n\n")).alias("pos", "block"))
    return blocks.select(*keep, "pos", strip("block").alias(TEXT)).where(F.col(TEXT) != "")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, text) of extracted document text, one document per file."""
    files = spark.read.text(path, wholetext=True)
    return split_paragraphs(files.select(F.col("_metadata.file_path").alias("path"), "value"), "value", "path")


def read_prompts(spark: SparkSession, path: str, fmt: str | None = None, ranges: bool = False) -> DataFrame:
    """(row_id, prompt) from a CSV with a ``prompt`` column, else from the lines of the file.

    ``row_id`` is the file's own column if it has one, else unique and rising inside each file split.
    With ``ranges`` large CSV files are read by many tasks, and each by its own header.
    """
    if (fmt or detect_format(path)) == "csv":
        rows = read_csv_ranges(spark, path) if ranges else read_csv(spark, path)
        if PROMPT not in rows.columns:
            raise SchemaError(f"CSV needs a prompt column; found {rows.columns}")
    else:
        rows = read_text_lines(spark, path).withColumnRenamed(TEXT, PROMPT)
    if "row_id" in rows.columns:
        return rows.select(F.col("row_id").cast("long").alias("row_id"), PROMPT)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), PROMPT)


def read_eval(spark: SparkSession, path: str, *keep: str, fmt: str | None = None, columns: tuple[str, ...] = (),
              ranges: bool = False) -> DataFrame:
    """(keep..., prompt, reference); a missing ``reference`` column reads as NULL.

    With ``columns``, the fields of a JSON Lines file, it is read once; else a pass infers them.
    With ``ranges`` large CSV files are read by many tasks, and each by its own header.
    """
    fmt = fmt or detect_format(path)
    if fmt == "csv":
        rows = read_csv_ranges(spark, path) if ranges else read_csv(spark, path)
    elif fmt == "jsonl":
        rows = read_jsonl(spark, path, *columns)
    else:
        raise UnsupportedFormat(f"evaluation data must be CSV or JSON Lines: {path}")
    if PROMPT not in rows.columns:
        raise SchemaError(f"need a prompt column; found {rows.columns}")
    reference = F.col(REFERENCE) if REFERENCE in rows.columns else F.lit(None)
    return rows.select(*keep, F.col(PROMPT).cast("string").alias(PROMPT), reference.cast("string").alias(REFERENCE))


def read_examples(spark: SparkSession, path: str, mapping: dict[str, str] | None = None,
                  preference: bool = False, fmt: str | None = None, null_token: str | None = None,
                  keep: tuple[str, ...] = (), columns: tuple[str, ...] = (), ranges: bool = False) -> tuple[DataFrame, Kind]:
    """Detect the format, read, map columns, resolve the kind, project to strings.

    With ``columns``, the fields of the file before mapping, JSON is read once; else a pass infers them.
    With ``ranges`` large CSV files and JSON arrays are read by many tasks, CSV files each by its own header.
    """
    fmt = fmt or detect_format(path)
    readers = {
        "csv": read_csv, "jsonl": read_jsonl, "json": read_json_array, "txt": read_text_lines,
        "paragraphs": read_paragraphs,
    }
    if ranges:
        readers |= {"csv": read_csv_ranges, "json": read_json_array_ranges}
    if fmt not in readers:
        raise UnsupportedFormat(f"no Spark reader for {path}")
    named = columns if fmt in ("csv", "jsonl", "json") else ()
    df = map_columns(readers[fmt](spark, path, *named), mapping or {})
    kind = require_kind(df.columns, preference)
    return stringify(df, kind, *keep, null_token=null_token), kind


def read_policy_prompts(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Prompts for policy tuning: the ``prompt`` column, else text, else instruction."""
    fmt = fmt or detect_format(path)
    readers = {"csv": read_csv, "jsonl": read_jsonl, "json": read_json_array, "txt": read_text_lines}
    if fmt not in readers:
        raise UnsupportedFormat(f"no Spark reader for {path}")
    return resolve_prompt(readers[fmt](spark, path)).select(F.col(PROMPT).cast("string").alias(PROMPT))
