"""Log files, node registry and track catalogues: names, JSON lines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import log_file

#: The log record; absent fields read as null.
LOG = (
    "schema_version int, host_ts long, runtime_id string, source string, level string, message string, target string, pipeline_id string, processor_id string,"
    " rhi_op string, source_ts string, source_seq long, intercepted boolean, channel string, attrs map<string,string>"
)
NODE = "schema_version int, runtime_id string, control_url string, pid long, hint string"
NODE_VERSION = 1
CATALOG = "version int, tracks array<struct<track_name:string,source_processor_type:string,source_port_name:string>>"


def listed(names: DataFrame) -> DataFrame:
    """(name, runtime_id, started) of the names that parse."""
    runtime, started = log_file(F.col("name"))
    return names.select("name", runtime.alias("runtime_id"), started.alias("started")).where("runtime_id is not null")


def newest(files: DataFrame) -> DataFrame:
    return files.groupBy("runtime_id").agg(F.max_by("name", "started").alias("name"))


def decode(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON lines in column value: malformed lines and those that are no objects are set aside."""
    d = lines.select("value", F.from_json("value", LOG + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull() & F.ltrim("value").startswith("{")
    return d.where(good).select("r.*").drop("_bad"), d.where(~F.coalesce(good, F.lit(False))).select("value")


def read_logs(spark: SparkSession, directory: str, names: str = "*-*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Records and rejects of all `<runtime>-<millis>.jsonl` files of a directory."""
    return decode(spark.read.option("pathGlobFilter", names).text(directory))


def follow_logs(spark: SparkSession, directory: str, names: str = "*-*.jsonl") -> DataFrame:
    """Records as files grow in number: the stream picks up a restarted runtime's new file by itself."""
    lines = spark.readStream.option("pathGlobFilter", names).text(directory)
    return decode(lines)[0]


def write_logs(records: DataFrame, directory: str) -> None:
    records.write.mode("append").json(directory)


def nodes(documents: DataFrame) -> DataFrame:
    """Registry entries of the known version; torn documents and unknown versions are skipped."""
    d = documents.select(F.from_json("value", NODE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("n"))
    return d.where(F.col("n._bad").isNull()).select("n.*").drop("_bad").where(F.col("schema_version") == NODE_VERSION)


def tracks(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode(F.from_json("value", CATALOG)["tracks"]).alias("t")).select("t.*")


def raw_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(index, pixels) of files of raw 4-byte pixels; an incomplete last frame is left out."""
    stride = width * height * 4
    files = spark.read.format("binaryFile").load(path)
    cut = F.expr(f"transform(sequence(0, int(length div {stride}) - 1), k -> substring(content, k * {stride} + 1, {stride}))")  # frames, not copies of the file
    return files.where(F.col("length") >= stride).select("path", F.posexplode(cut).alias("index", "pixels"))


def repeat_file(spark: SparkSession, path: str, count: int, fps: float) -> DataFrame:
    """One file sent again and again: seq, timestamp_ns, payload."""
    file = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    return file.select(every.alias("seq"), F.col("content").alias("payload")).select("seq", (F.col("seq") * F.lit(int(1e9 / fps))).alias("timestamp_ns"), "payload")
