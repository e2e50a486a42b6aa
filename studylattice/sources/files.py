"""Scans and sinks: attempt logs, question banks, plans and schedules."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylattice.sources import schemas


# Times are written as ISO-8601 to the second, with a fraction where there is one;
# quotes inside a cell are doubled, and white space is part of the cell.
_CSV_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
_CSV_CELLS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


# The folders of a log are named by this column.
_BATCH = "batch"


class MissingColumns(ValueError):
    """A file lacks columns the operators need."""


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise MissingColumns("missing required columns: " + ", ".join(missing))
    return df


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line; reads no more than that."""
    return spark.read.options(**_CSV_CELLS).option("header", True).csv(path).columns


def read_attempts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Attempt log from CSV with a header, in any column order that all files share; a file with
    another header is an error.

    Header names are trimmed and lower-cased. Times may have a T or a space, and may end at the
    minute. Rows without a readable user or time, and rows with a number that cannot be read, are left to
    ``rejected_attempts``; an empty cell is NULL. If the header has no ``log_pos``, that is the number of the line, from
    0, over all files by time of change and name; see ``_numbered_lines``.
    """
    cells = _attempt_cells(spark, path)
    if "log_pos" not in cells.columns:
        cells = _numbered_lines(cells)
    log = cells.drop(*_PLACE).filter(_reason(cells).isNull())
    types = {**schemas.ATTEMPT_TYPES, "userid": T.LongType()}
    log = log.select(*[F.col(f"`{n}`").try_cast(types.get(n, T.StringType())).alias(n) for n in log.columns])
    known = {old: new for old, new in schemas.ATTEMPT_RENAMES.items() if old in log.columns}
    log = log.withColumnsRenamed(known)
    needed = [schemas.ATTEMPT_RENAMES.get(n, n) for n in schemas.ATTEMPT_HEADER]
    return require_columns(log, needed)


# Where a line was read: its file, the split of the file, and a number that grows inside a split.
_PLACE = ("_changed", "_file", "_start", "_row")


def _attempt_cells(spark: SparkSession, path: str) -> DataFrame:
    """The log's cells as text, and where each line was read. Every file's header is checked against the
    first one's."""
    names = _header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    cells = spark.read.schema(schema).options(**_CSV_CELLS).csv(path, header=True, enforceSchema=False)
    place = (
        F.col("_metadata.file_modification_time"),
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )
    named = [F.col(f"`{old}`").alias(old.strip().lower()) for old in names]
    return cells.select(*named, *[column.alias(name) for name, column in zip(_PLACE, place)])


def _numbered_lines(cells: DataFrame) -> DataFrame:
    """Add ``log_pos``, the number of the line: the lines of all splits before, plus the place in its split.

    The sums run over a row for each split. A task reads the lines of a split one after the other, so the
    first row number of a split tells the others' places in it. The log is read twice, the first time
    for the counts alone.
    """
    split = ["_changed", "_file", "_start"]
    splits = cells.groupBy(*split).agg(F.count("*").alias("_lines"), F.min("_row").alias("_first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select(
        *split, (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_base")
    )
    return cells.join(bases, split).withColumn("log_pos", F.col("_row") + F.col("_base")).drop("_base")


def _reason(cells: DataFrame) -> Column:
    """Name of the cell that makes a row useless, NULL for a good row: user and time must be there, numbers
    must be readable where they are."""
    user = "userid" if "userid" in cells.columns else "user_id"
    needed = [(user, "bigint"), ("timestamp", "timestamp_ntz")]
    bad = [F.when(F.col(n).try_cast(t).isNull(), F.lit(n)) for n, t in needed if n in cells.columns]
    for name, kind in schemas.ATTEMPT_TYPES.items():
        if name in cells.columns and isinstance(kind, T.NumericType) and name not in (user, "log_pos"):
            cell = F.col(f"`{name}`")
            bad.append(F.when((F.trim(cell) != "") & cell.try_cast(kind).isNull(), F.lit(name)))
    return F.coalesce(*bad) if bad else F.lit(None).cast("string")


def rejected_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Rows that ``read_attempts_csv`` leaves out, as text, with the ``reason``."""
    cells = _attempt_cells(spark, path)
    return cells.withColumn("reason", _reason(cells)).filter("reason is not null").drop(*_PLACE)


def read_attempts_parquet(spark: SparkSession, path: str) -> DataFrame:
    needed = ["attempt_ts", "user_id", "subject", "difficulty", "score", "total"]
    return require_columns(spark.read.parquet(path), needed)


def write_attempts_csv(attempts: DataFrame, path: str, mode: str = "append") -> None:
    """Append attempts to a CSV log, one header per file. Runs a job."""
    names = {new: old for old, new in schemas.ATTEMPT_RENAMES.items() if old != "userid"}
    columns = [names.get(c, c) for c in attempts.columns]
    attempts.toDF(*columns).write.mode(mode).options(**_CSV_TIME, **_CSV_CELLS).csv(path, header=True)


def append_attempts(numbered: DataFrame, path: str, batch: str) -> bool:
    """Append numbered attempts to a Parquet log as the batch of that name; a new log is created. Runs a job.

    The rows are written to a folder that readers pass over and get their name by one rename, which fails
    if the name is taken. So a batch is in the log whole or not at all, and one that is appended again,
    after a failure or by two drivers at once, counts once. Returns whether this call added it. The rename must be
    atomic, as it is in HDFS and in local files.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, _ and -: {batch!r}")
    spark = numbered.sparkSession
    if _exists(spark, f"{path}/{_BATCH}={batch}"):
        return False
    staged = f"{path}/_staged/{batch}-{uuid.uuid4().hex}"
    numbered.write.parquet(staged)
    return _renamed(spark, staged, f"{path}/{_BATCH}={batch}")


def read_attempt_log(spark: SparkSession, path: str) -> DataFrame:
    """The attempts of all batches of a log that ``append_attempts`` has written."""
    return read_attempts_parquet(spark, path).drop(_BATCH)


def _files(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    found, system = _files(spark, path)
    return system.exists(found)


def _renamed(spark: SparkSession, staged: str, path: str) -> bool:
    """Give a folder its name unless the name is taken; then the folder goes."""
    (source, system), (target, _) = _files(spark, staged), _files(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    keep[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        context.rename(source, target, keep)
    except Py4JJavaError as error:
        if not system.exists(target):
            raise
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        system.delete(source, True)
        return False
    return True


def read_questions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Question bank from CSV; cells may hold doubled quotes, commas and line breaks. Cells beyond the header are ignored, so a line with an unquoted
    comma keeps its shifted cells and can never be answered."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in schemas.QUESTION_HEADER])
    bank = spark.read.schema(schema).options(**_CSV_CELLS).csv(
        path, header=True, enforceSchema=False, mode="PERMISSIVE", multiLine=True
    )
    return bank.toDF(*[name.lower() for name in schemas.QUESTION_HEADER])


def write_csv(rows: DataFrame, path: str) -> None:
    """Plan or schedule as CSV with a header in every part file. Runs a job.

    The parts are left as Spark makes them: a folder per request would be as many files as
    requests.
    """
    rows.write.mode("errorifexists").options(**_CSV_CELLS).csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A plan or schedule that ``write_csv`` has written."""
    return spark.read.schema(schema).options(**_CSV_CELLS).csv(path, header=True)
