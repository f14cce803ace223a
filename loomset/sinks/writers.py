"""Result CSV, split Parquet, dataset card and version registry."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomset.functions.text import example_length
from loomset.operators.clean import validation_report
from loomset.schema import Kind, OVER_LENGTH


def write_csv(df: DataFrame, path: str) -> None:
    """Header, all fields quoted, quotes doubled, text as it is."""
    (
        df.write.option("header", True).option("quoteAll", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_split(labelled: DataFrame, path: str) -> None:
    """A Parquet folder per value of ``split``."""
    labelled.write.partitionBy("split").parquet(path)


def dataset_card(df: DataFrame, kind: Kind) -> DataFrame:
    """(line_no, line): the data section of a card, from one pass over the table."""
    length = example_length(kind)
    facts = df.agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("mean"),
        F.coalesce(F.min(length), F.lit(0)).alias("least"),
        F.coalesce(F.max(length), F.lit(0)).alias("most"),
        F.count_if(length > OVER_LENGTH).alias("over"),
    )
    whole = lambda c: F.format_string("%d", c.cast("long"))
    lines = [
        F.lit("## Training Data"),
        F.concat(F.lit("- Examples: "), whole(F.col("n"))),
        F.concat(F.lit("- Average length: "), whole(F.round("mean", 0)), F.lit(" chars")),
        F.concat(F.lit("- Shortest and longest: "), whole(F.col("least")), F.lit(" and "), whole(F.col("most"))),
        F.concat(F.lit(f"- Over {OVER_LENGTH} chars: "), whole(F.col("over"))),
    ]
    return facts.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def write_card(df: DataFrame, kind: Kind, path: str, raw: DataFrame | None = None) -> None:
    """Card and validation issues (a dozen lines) as one text file folder.

    Issues are those of ``raw``, the table before cleaning, if it is given.
    """
    issues = validation_report(df if raw is None else raw, kind).select(
        F.lit(100).alias("line_no"), F.format_string("- Issue %s: %d", "issue", "n").alias("line")
    )
    card = dataset_card(df, kind).union(issues).coalesce(1).sortWithinPartitions("line_no", "line")
    card.select("line").write.text(path)


class DatasetRegistry:
    """Versioned datasets below one root: ``data/<folder>`` and a log of numbered commits.

    A commit is a file of one metadata row, which names the folder, or of a withdrawal. It is created
    under the next number only if no file has that number, so that of writers that come at once one
    gets it and the others read the log again. It is written last: a listed version is complete, and
    one whose writing was cut short can be published again.
    """

    SCHEMA = (
        "base_model string, notes string, trained_with string, version string, uploaded_at string, "
        "num_examples long, folder string, extra map<string,string>, name string, action string"
    )
    _FIELDS = {"base_model": "unknown", "notes": "", "trained_with": ""}

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def publish(self, df: DataFrame, version: str, metadata: dict[str, str] | None = None) -> DataFrame:
        """Write the data, then commit its metadata; returns the row.

        ``metadata`` beyond the known fields goes to the map ``extra``. A version that is listed
        is an error, also if another writer has published it meanwhile.
        """
        version = version.strip()
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._+-]*", version):
            raise ValueError(f"a version tag is letters, digits and . _ + -, such as 1.0; not {version!r}")
        self._check_free(version)
        folder = f"{version}-{uuid.uuid4().hex}"
        target = f"{self.root}/data/{folder}"
        df.write.parquet(target)
        given = metadata or {}
        stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        rows, at = self.spark.read.schema(df.schema).parquet(target).agg(F.count("*"), stamp).first()
        self._commit(version, lambda: self._check_free(version), {
            **{k: given.get(k, v) for k, v in self._FIELDS.items()},
            "uploaded_at": at, "num_examples": rows, "folder": folder, "name": f"metadata_v{version}.json",
            "extra": {k: v for k, v in given.items() if k not in self._FIELDS}, "action": "publish",
        })
        return self._row(version)

    def withdraw(self, version: str) -> None:
        """Take a version from the list; its data stays. It may then be published anew."""
        version = version.strip()
        self._commit(version, lambda: self._check_listed(version), {"action": "withdraw"})

    def list_versions(self) -> DataFrame:
        """(name, version, num_examples) in the order of the names as text; no rows if nothing is published."""
        return self._metadata().select("name", "version", "num_examples").orderBy("name")

    def load(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/{self._check_listed(version.strip())}")

    def _check_listed(self, version: str) -> str:
        found = self._row(version).select("folder").first()
        if found is None:
            raise ValueError(f"version {version} does not exist")
        return found["folder"]

    def _check_free(self, version: str) -> None:
        if not self._row(version).isEmpty():
            raise ValueError(f"version {version} already exists")

    def _commit(self, version: str, check: Callable[[], Any], row: dict[str, Any]) -> None:
        """Append to the log; ``check`` passes on all that comes before, or raises."""
        while True:
            last = self._log().agg(F.max("commit")).first()[0] or 0
            check()
            # What was committed after the log was read has the next number, so that this one is refused.
            if create_new(self.spark, f"{self.root}/log/{last + 1:020d}.json", json.dumps({"version": version, **row})):
                return

    def _row(self, version: str) -> DataFrame:
        return self._metadata().where(F.col("version") == version)

    def _metadata(self) -> DataFrame:
        """The versions that the log, replayed, leaves."""
        log = self._log()
        last = log.groupBy("version").agg(F.max_by(F.struct(*[c for c in log.columns if c != "version"]), "commit").alias("last"))
        return last.select("version", "last.*").where("action = 'publish'")

    def _log(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.SCHEMA).json(f"{self.root}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{self.SCHEMA}, commit long")
        return rows.withColumn("commit", F.regexp_extract("_metadata.file_name", r"\d+", 0).cast("long"))


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text at once; False if there is one already.

    A hidden file is written first and then put in place: by a link on a local file system, elsewhere
    by a rename that fails if the name is taken, as on HDFS.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    draft = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getScheme() != "file":
            return files.rename(draft, target)
        os.link(draft.toUri().getPath(), target.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        files.delete(draft, False)
