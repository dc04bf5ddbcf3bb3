"""Reading and writing tables. Scans stay lazy, so filters and columns reach the files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from verbena.frame import Frame
from verbena.frame import session as current

FORMATS = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".csv.gz": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".txt": "text"}


def format_of(path: str) -> str:
    for end in sorted(FORMATS, key=len, reverse=True):
        if path.rstrip("/").endswith(end):
            return FORMATS[end]
    return "parquet"


def read(path: str, format: str | None = None, schema: str | None = None, keep_order: bool = False, session: SparkSession | None = None, **options) -> Frame:
    """A table by its format or file ending. With ``keep_order`` rows have the order of file
    and place in the file (for Parquet; a key that leaves filters pushed down)."""
    kind = format or format_of(path)
    reader = (session or current()).read.format(kind).options(**options)
    if kind == "csv":
        reader = reader.option("header", options.get("header", True)).option("sep", options.get("sep", "\t" if path.endswith(".tsv") else ",")).option("nullValue", options.get("nullValue", "NA"))
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if not keep_order:
        return Frame(df)
    own = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    return Frame(own, order=[("__file", False), ("__index", False)])


def write(frame: Frame, path: str, format: str | None = None, mode: str = "error", partition_by: list[str] | None = None, bucket_by: tuple[int, list[str]] | None = None, **options) -> None:
    """Write a frame; a row order is written as the order of the files. ``bucket_by`` (number,
    columns) saves a bucketed table of the name ``path`` for joins without a shuffle."""
    kind = format or format_of(path)
    if kind == "csv":
        options = {"header": True, "nullValue": "NA"} | options
    writer = frame.visible().write.format(kind).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer.bucketBy(bucket_by[0], *bucket_by[1]).saveAsTable(path)
    else:
        writer.save(path)


def sql(query: str, session: SparkSession | None = None, **frames: Frame) -> Frame:
    """Spark SQL over named frames."""
    spark = session or current()
    for name, frame in frames.items():
        frame.df.select(*[F.col(f"`{c}`") for c in frame.columns]).createOrReplaceTempView(name)
    return Frame(spark.sql(query))
