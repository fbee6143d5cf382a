"""Sinks: partitioned writes, verified writes, reports, models and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import stage


def counted_write(df: DataFrame, write) -> int:
    """Run a write and return its row count without a second pass over the data."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return int(seen.get["n"])


#: Bytes that one range of a partitioned write aims at, as stored.
FILE_BYTES = 256 << 20
#: Bytes that the rows of one range take in the task that sorts them; repeated values hardly show in the stored size.
SORT_BYTES = 256 << 20


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the Parquet files that a table is read from; file sizes are listed, contents are not read."""
    folders = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    if not folders:
        return 0
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def row_bytes(df: DataFrame) -> int:
    """Bytes of all rows of a table as a sort holds them: fixed fields, pointers, and the texts and binaries themselves."""
    sized = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    nested = [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c, t in df.dtypes if t.startswith(("array<", "struct<", "map<"))]
    fixed = F.lit(32 + 9 * len(df.columns)).cast("long")
    return df.agg(F.coalesce(F.sum(sum([*sized, *nested], fixed)), F.lit(0))).first()[0]


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], cluster: Sequence[str] = (),
                      partitions: int | None = None, file_bytes: int = FILE_BYTES) -> int:
    """Write Parquet partitioned by ``by`` and sorted by ``cluster`` inside each file.

    The plan runs once: its rows are staged, and the staged table tells how many ranges of about
    ``file_bytes`` as stored, or of ``SORT_BYTES`` as sorted, there are (``partitions`` sets the number
    instead). Rows are then range-distributed on (by, cluster), so every file holds a narrow key range
    and min/max statistics prune row groups. A hash of the other columns is the last part of a range's key: a group larger than a range is spread
    over several. Rows that are equal in every column stay together. Returns the rows written.
    """
    keys = [*by, *cluster]
    rows = stage(df, "layout")
    ranges = partitions or max(1, -(-stored_bytes(rows) // file_bytes), -(-row_bytes(rows) // SORT_BYTES))
    salt = [c for c, t in rows.dtypes if c not in keys and "map<" not in t and t != "variant"]
    spread = [*keys, F.xxhash64(*salt)] if salt else keys
    ordered = rows.repartitionByRange(ranges, *spread).sortWithinPartitions(*keys)
    return counted_write(ordered, lambda d: d.write.mode("overwrite").partitionBy(*by).parquet(path))


def verified_write(df: DataFrame, path: str) -> DataFrame:
    """Replace a Parquet table and fail unless the re-read copy has the same rows and columns."""
    written = counted_write(df, lambda d: d.write.mode("overwrite").parquet(path))
    back = df.sparkSession.read.parquet(path)
    stored = back.count()
    if stored != written:
        raise RuntimeError(f"{path}: wrote {written} rows but {stored} came back")
    if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
        raise RuntimeError(f"{path}: the stored schema differs from the one written")
    return back


def load_abt(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             years: Sequence[int] | None = None, year_col: str = "ano") -> DataFrame:
    """Read the analytical base table; columns and years are pruned at the scan."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.where(F.col(year_col).isin(list(years)))
    return df.select(*columns) if columns is not None else df


def write_report(df: DataFrame, folder: str, name: str, fmt: str = "csv",
                 single_file: bool = False) -> str:
    """Write a result table. ``single_file`` is for small, already reduced tables only."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown report format: {fmt}")
    target = f"{folder.rstrip('/')}/{name}"
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(target)
    return target


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline; a missing one is an error with a plain message, other failures stay as they are."""
    metadata = f"{path.rstrip('/')}/metadata"
    try:
        SparkSession.active().read.text(metadata)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no trained model under {path}; train one first") from err
        raise
    return PipelineModel.load(path)


def save_scores(scores: DataFrame, path: str) -> int:
    """Store the long score table (row id, model, y, p, ...), one folder per model."""
    return counted_write(
        scores, lambda d: d.write.mode("overwrite").partitionBy("model").parquet(path))


def load_scores(spark: SparkSession, path: str, expected: DataFrame | None = None,
                row_id: str = "row_id", models: Sequence[str] | None = None) -> DataFrame:
    """Read scores and check them against the rows they should cover.

    Every model must have scored exactly the expected row ids: none missing, none extra.
    """
    scores = spark.read.parquet(path)
    found = [r[0] for r in scores.select("model").distinct().collect()]
    if models is not None and sorted(found) != sorted(models):
        raise ValueError(f"scores hold models {sorted(found)}, expected {sorted(models)}")
    if expected is not None:
        ids = expected.select(row_id)
        extra = scores.join(ids, row_id, "left_anti").limit(1).count()
        per_row = scores.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"))
        missing = (ids.join(per_row, row_id, "left")
                   .where(F.coalesce("n", F.lit(0)) != len(found)).limit(1).count())
        if extra or missing:
            raise ValueError("the score table does not cover the expected rows one to one")
    return scores


