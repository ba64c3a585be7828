"""Files as rows: directory scans, admission, and the raw store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrake.config import EXTENSIONS, Settings
from quillrake.functions.text import stable_id
from quillrake.operators import formats


def _suffixes(extensions) -> str:
    """A glob of file names that end in one of the extensions, in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scan(spark: SparkSession, path: str | list[str], recursive: bool = False, settings: Settings = Settings(), extensions=EXTENSIONS) -> DataFrame:
    """(file_path, size_bytes, modified, content) of the files under path, or of the files named.

    Of a folder only files with a supported suffix (in any case) are listed; files that are named are listed whatever
    their suffix. Files over the limit are listed without their content, which is then never read. Spark's reader
    leaves out files without any byte: they are no rows here.
    """
    paths = [path] if isinstance(path, str) else list(path)
    read = lambda some: spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).options(**some)
    parts = []
    folders = [p for p in paths if is_folder(spark, p)]
    for where, options in ((folders, {"pathGlobFilter": _suffixes(extensions)}), ([p for p in paths if p not in folders], {})):
        if where:
            most, found = settings.max_file_size_mb * 1024 * 1024, read(options).load(where)
            told = [F.col("path").alias("file_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")]
            parts.append(found.where(F.col("length") <= most).select(*told, "content"))
            large = found.where(F.col("length") > most).select(*told, F.lit(None).cast("binary").alias("content"))
            if not large.isEmpty():  # a listing: no content is read
                parts.append(large)
    return reduce(DataFrame.unionByName, parts)


def admitted(files: DataFrame, settings: Settings = Settings(), extensions: dict[str, str] | None = None) -> DataFrame:
    """files with document_id, ext, file_hash, mime_type, mime_expected, format, status, error_message.

    Files of an unknown extension, empty or over the limit fail. extensions: format by extension, where it is not the
    usual table.
    """
    ext = formats.extension(F.col("file_path"))
    told = files.withColumns({"ext": ext, "file_hash": F.sha2("content", 256)})
    told = told.withColumns({"mime_type": formats.mime_type(F.col("ext")), "document_id": stable_id("doc", F.col("file_path"), F.col("file_hash"))})
    error = (
        F.when(~F.col("ext").isin(list(extensions or EXTENSIONS)), F.concat(F.lit("unsupported extension: "), F.col("ext")))
        .when(F.col("size_bytes") == 0, "empty file")
        .when(F.col("size_bytes") > settings.max_file_size_mb * 1024 * 1024, "file too large")
    )
    return told.withColumns(
        {
            "mime_expected": formats.mime_expected(F.col("ext"), F.col("mime_type")),
            "format": F.coalesce(*([formats.lookup(extensions, F.col("ext"))] if extensions else []), formats.format_of(F.col("mime_type"), F.col("ext"), F.col("content"))),
            "error_message": error,
            "status": F.when(error.isNotNull(), "failed").otherwise("pending"),
        }
    )


def copies(files: DataFrame) -> DataFrame:
    """(file_path, file_hash, is_duplicate): is there an earlier path with the same bytes? Only paths and hashes move."""
    slim = files.select("file_path", "file_hash")
    first = slim.groupBy("file_hash").agg(F.min("file_path").alias("first"))
    return slim.join(first, "file_hash", "left").select("file_path", "file_hash", F.coalesce(F.col("file_path") > F.col("first"), F.lit(False)).alias("is_duplicate"))


def storage_stats(files: DataFrame) -> DataFrame:
    """Per extension: files, bytes, average KB."""
    return files.groupBy(formats.extension(F.col("file_path")).alias("ext")).agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes"), F.round(F.avg(F.col("size_bytes") / 1024), 3).alias("average_kb"))
