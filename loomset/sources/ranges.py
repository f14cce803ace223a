"""Large single files, read by many tasks: CSV with quoted line breaks, and top-level JSON arrays.

Spark cuts a file into ranges of bytes and each range into pieces at a separator. Whether a record
ends with a piece depends on all that stands before it in the file; but a range only changes a
small state (inside quotes or not; depth), and how it does is known from the range alone, for each
state it may be entered in. So one pass summarises the ranges, the summaries are composed in the
order of the file, and a second pass puts records together where they lie. Only what crosses the
edges of ranges is moved. Spark's own parsers read the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from loomset.operators.projection import SchemaError
from loomset.runtime import BROADCAST_BYTES, materialise

RANGE_ROWS = 200_000  # most ranges whose states are broadcast
MOST_HEADERS = 1000  # different headers in a folder


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(piece, file, start, at): the file's pieces; ``at`` rises inside a range."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("value").alias("piece"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
    )


def _with_state(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """``pieces`` with the columns of their range, in order; ranges that were cut otherwise are an error.

    Spark cuts files by the cores it sees, which may change between two passes.
    """
    rows, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("file") + 64), F.lit(0))).first()
    fits = rows <= RANGE_ROWS and size <= BROADCAST_BYTES
    changed = F.raise_error(F.lit("files were cut anew between two passes; set spark.sql.files.minPartitionNum")).cast("boolean")
    placed = pieces.join(F.broadcast(ranges) if fits else ranges, ["file", "start"], "left")
    placed = placed.withColumn("entered", F.coalesce("entered", changed))
    return placed if fits else placed.repartition("file", "start").sortWithinPartitions("file", "start", "at")


def _assembled(pieces: DataFrame, separator: str, states) -> DataFrame:
    """(file, start, part, ends, record) from pieces with the state of their range.

    ``states(columns)`` gives whether a record ends with each piece of a run of one range, the run's
    exit state being handed to the next run. Part 0 of a range is all up to its first end, part 2
    what is left after its last one, and part 1 the whole records between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = carried = None
        held: list[str] = []
        seen_end = False
        for batch in batches:
            files, starts = batch.column("file"), batch.column("start").to_numpy()
            pieces = batch.column("piece")
            out: list[tuple] = []
            cuts = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), batch.num_rows]
            if batch.num_rows and files[0] != files[batch.num_rows - 1]:
                changed = files.slice(1).to_numpy(zero_copy_only=False) != files.slice(0, batch.num_rows - 1).to_numpy(zero_copy_only=False)
                cuts = sorted({*cuts, *(np.flatnonzero(changed) + 1).tolist()})
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                here = (files[low].as_py(), int(starts[low]))
                if here != key:
                    if held:
                        out.append((*key, 2, False, separator.join(held)))
                    key, carried, held, seen_end = here, None, [], False
                ends, carried = states(batch.slice(low, high - low), carried)
                some = pieces.slice(low, high - low).to_pylist()
                last = 0
                for end in np.flatnonzero(ends).tolist():
                    record = some[last] if end == last and not held else separator.join([*held, *some[last : end + 1]])
                    held = []
                    out.append((*key, 1 if seen_end else 0, True, record))
                    seen_end, last = True, end + 1
                held += some[last:]
            if out:
                yield _rows(out)
        if held:
            yield _rows([(*key, 2, False, separator.join(held))])

    return pieces.mapInArrow(run, "file string, start bigint, part int, ends boolean, record string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    files, starts, parts, ends, records = zip(*out)
    return pa.RecordBatch.from_arrays(
        [pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(parts, pa.int32()), pa.array(ends, pa.bool_()), pa.array(records, pa.string())],
        names=["file", "start", "part", "ends", "record"],
    )


def _stitched(assembled: DataFrame, separator: str) -> DataFrame:
    """(file, record, first): whole records; what ranges hold in parts is put together, at most two parts a range."""
    in_file = Window.partitionBy("file").orderBy("start", "part")
    edges = assembled.where("part <> 1").withColumn(
        "chain", F.coalesce(F.sum(F.col("ends").cast("int")).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    parts = F.array_sort(F.collect_list(F.struct("start", "part", "record")))
    whole = edges.groupBy("file", "chain").agg(
        F.array_join(F.transform(parts, lambda p: p["record"]), separator).alias("record"), F.max("ends").alias("ended")
    )
    inner = assembled.where("part = 1").select("file", "record", F.lit(False).alias("first"), F.lit(True).alias("ended"))
    return whole.select("file", "record", (F.col("chain") == 0).alias("first"), "ended").unionByName(inner)


# --- CSV


def _odd_quotes(piece: Column) -> Column:
    return (F.length(piece) - F.length(F.replace(piece, F.lit('"'), F.lit("")))) % 2 == 1


def _csv_ends(rows: pa.RecordBatch, carried: bool | None) -> tuple[np.ndarray, bool]:
    """A record ends with a line after which quotes are even."""
    inside = rows.column("entered")[0].as_py() if carried is None else carried
    odd = rows.column("odd").to_numpy(zero_copy_only=False)
    after = (np.cumsum(odd) + inside) % 2 == 1
    return ~after, bool(after[-1])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, first, ended): the records of CSV files as text, quoted line breaks inside.

    ``first`` marks the header of a file. Doubled quotes leave the parity of quotes as it is, so that
    only the parity decides whether a line break stands inside quotes; fields that are not quoted must
    hold no quote.
    """
    lines = _pieces(spark, path, "\n").withColumn("odd", _odd_quotes(F.col("piece")))
    ranges = materialise(lines.groupBy("file", "start").agg(F.sum(F.col("odd").cast("int")).alias("n_odd")), "ranges")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    entered = (F.coalesce(F.sum("n_odd").over(before), F.lit(0)) % 2 == 1).alias("entered")
    placed = _with_state(lines, ranges.select("file", "start", entered))
    assembled = _assembled(placed.select("file", "start", "piece", "odd", "entered"), "\n", _csv_ends)
    return _stitched(materialise(assembled, "records"), "\n")


def read_csv_ranges(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """As :func:`loomset.sources.readers.read_csv`, with every file cut into ranges and read by its own header.

    Without ``columns`` those of all headers, in order of first name; a file without one of them has
    NULL there. A column asked for that no header has is an error. Files are read twice, and their
    records written once.
    """
    records = csv_records(spark, path).withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")
    heads = records.where("first").groupBy("record").agg(F.count("*").alias("files")).limit(MOST_HEADERS + 1).collect()
    if len(heads) > MOST_HEADERS:
        raise SchemaError(f"{path}: more than {MOST_HEADERS} different headers")
    names = {r["record"]: _header(spark, r["record"]) for r in heads}
    known = list(dict.fromkeys(c for head in sorted(names) for c in names[head]))
    if missing := [c for c in columns if c not in known]:
        raise SchemaError(f"{path}: no column {', '.join(missing)} in the headers {', '.join(known)}")
    width = max(map(len, names.values()), default=0)
    head_of = records.where("first").select("file", F.col("record").alias("head"))
    body = records.where("not first").join(head_of, "file")
    parsed = F.from_csv("record", ", ".join(f"c{i} string" for i in range(max(width, 1))), {"escape": '"', "multiLine": "true"})
    body = body.select("head", parsed.alias("fields"))

    def named(column: str) -> Column:
        places: dict[int, list[str]] = {}
        for head, cols in names.items():
            if column in cols:
                places.setdefault(cols.index(column), []).append(head)
        cases = [F.when(F.col("head").isin(of), F.col(f"fields.c{i}")) for i, of in places.items()]
        return F.coalesce(*cases).alias(column)

    return body.select(*[named(c) for c in columns or known])


def _header(spark: SparkSession, record: str) -> list[str]:
    """The names in a header, as Spark's reader gives them."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(
        spark.sparkContext.parallelize([record], 1)
    ).columns


# --- JSON arrays


def _outside(piece: Column, entered: bool) -> Column:
    """What of a piece stands outside of strings, if it is entered outside or inside of one."""
    plain = F.regexp_replace(piece, r"(?s)\\.", "")
    if entered:
        plain = F.regexp_replace(plain, r'\A[^"]*("|\z)', "")
    return F.regexp_replace(plain, r'"[^"]*("|\z)', "")


def _depth(outside: Column, closed: Column) -> Column:
    count = lambda letters: F.length(outside) - F.length(F.translate(outside, letters, ""))
    return count("{[") - count("}]") - closed.cast("int")


def _array_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces up to each ``}``: whether they turn the state of strings, and what they add to the depth."""
    pieces = _pieces(spark, path, "}")
    odd = _odd_quotes(F.regexp_replace("piece", r"(?s)\\.", ""))
    # The brace that ends the piece counts where the piece is left outside of strings.
    return pieces.withColumn("odd", odd).withColumns({
        "from_out": _depth(_outside(F.col("piece"), False), ~F.col("odd")),
        "from_in": _depth(_outside(F.col("piece"), True), F.col("odd")),
    })


def _range_depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of one range: pieces in order, summed for both states of entry."""
    for batch in batches:
        order = batch.column("at").to_numpy()
        odd, out, inn = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("odd", "from_out", "from_in"))
        keys = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
        rows = []
        for low, high in zip(cuts, cuts[1:]):
            if low < high:
                some = slice(low, high)
                inside = (np.cumsum(odd[some]) - odd[some]) % 2 == 1
                rows.append((
                    int(keys[low]), int(order[low]), int(odd[some].sum() % 2),
                    int(np.where(inside, inn[some], out[some]).sum()), int(np.where(inside, out[some], inn[some]).sum()),
                ))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "at", "odd", "from_out", "from_in"])


def _array_ends(rows: pa.RecordBatch, carried: tuple[bool, int] | None) -> tuple[np.ndarray, tuple[bool, int]]:
    """An element ends with a piece that is left outside of strings, back in the array itself."""
    inside, depth = (rows.column("entered")[0].as_py(), rows.column("depth")[0].as_py()) if carried is None else carried
    odd, out, inn = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("odd", "from_out", "from_in"))
    after = (np.cumsum(odd) + inside) % 2 == 1
    was_inside = np.concatenate([[inside], after[:-1]])
    depths = depth + np.cumsum(np.where(was_inside, inn, out))
    return ~after & (depths == 1), (bool(after[-1]), int(depths[-1]))


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element): the objects of top-level arrays, as text; a file that holds anything else is an error."""
    pieces = _array_pieces(spark, path)
    keyed = pieces.withColumn("key", F.xxhash64("file", "start"))
    runs = keyed.select("key", "at", "odd", "from_out", "from_in").mapInArrow(
        _range_depths, "key bigint, at bigint, odd bigint, from_out bigint, from_in bigint"
    )
    # Runs of a range, one per batch, then ranges of a file: first the state of strings, then the depth.
    names = keyed.groupBy("key", "file", "start").agg(
        F.min_by(F.substring(F.regexp_replace("piece", r"\A\s+", ""), 1, 1), "at").alias("lead")
    )
    ranges = materialise(names.join(runs, "key"), "ranges")
    in_file = Window.partitionBy("file")
    earlier = in_file.orderBy("start", "at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("entered", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1)
    ranges = ranges.withColumn("added", F.when(F.col("entered"), F.col("from_in")).otherwise(F.col("from_out")))
    ranges = ranges.withColumns({"depth": F.coalesce(F.sum("added").over(earlier), F.lit(0)), "whole": F.sum("added").over(in_file)})
    states = ranges.groupBy("file", "start").agg(F.min_by(F.struct("entered", "depth", "lead", "whole"), "at").alias("s")).select("file", "start", "s.*")
    wrong = F.raise_error(F.concat(F.col("file"), F.lit(": expected a top-level array of objects"))).cast("boolean")
    # The end of a file is counted as one more closing brace than there is.
    array = ((F.col("start") > 0) | F.startswith("lead", F.lit("["))) & (F.col("whole") == -1)
    states = materialise(states.select("file", "start", F.when(array, F.col("entered")).otherwise(wrong).alias("entered"), "depth"), "states")
    placed = _with_state(pieces, states)
    columns = ("file", "start", "piece", "odd", "from_out", "from_in", "entered", "depth")
    whole = _stitched(materialise(_assembled(placed.select(*columns), "}", _array_ends), "elements"), "}")
    # The first element of a file follows its bracket, the others a comma; after the last one the bracket closes.
    lead = F.when(F.col("first"), F.lit(r"\A\s*\[\s*")).otherwise(F.lit(r"\A\s*,\s*"))
    element = F.concat(F.regexp_replace(F.col("record"), lead, F.lit("")), F.when(F.col("ended"), F.lit("}")).otherwise(F.lit("")))
    whole = whole.select("file", element.alias("element"), "ended", "first")
    rest_is_end = F.col("element").rlike(r"\A\s*\]\s*\z")
    good = F.when(F.col("ended"), F.startswith("element", F.lit("{"))).otherwise(rest_is_end)
    return whole.where(F.when(good, F.col("ended")).otherwise(wrong)).select("file", "element")


def read_json_array_ranges(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """As :func:`loomset.sources.readers.read_json_array`, with every file cut into ranges; all values are strings.

    Name the ``columns`` to spare the pass that collects the names of all fields. A broken object is
    an error. Files are read twice; that they hold arrays shows in the first range.
    """
    elements = json_elements(spark, path)
    if not columns:
        keys = elements.select(F.explode(F.json_object_keys("element")).alias("name")).distinct()
        columns = tuple(sorted(r["name"] for r in keys.collect()))
        if not columns:
            return spark.createDataFrame([], T.StructType())
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return elements.select(F.from_json("element", schema, {"mode": "FAILFAST"}).alias("o")).select(*[F.col("o").getField(c).alias(c) for c in columns])
