"""File listings of a data lake: sizes, types, checksums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKSUMS: dict[str, Callable[[Column], Column]] = {
    "md5": F.md5,
    "sha1": F.sha1,
    "sha256": lambda c: F.sha2(c, 256),
}
#: bytes of a file that a task holds at once
PIECE = 1 << 22
# fixed values: file kind by extension
FILE_TYPES = {
    "nc": "netcdf",
    "hdf": "hdf4",
    "h5": "hdf5",
    "tif": "geotiff",
    "tiff": "geotiff",
    "csv": "csv",
    "json": "json",
    "png": "image",
    "jpg": "image",
    "jpeg": "image",
    "pdf": "pdf",
    "html": "html",
    "parquet": "parquet",
    "pkl": "pickle",
    "feather": "feather",
}


def _file_type(ext: Column) -> Column:
    out = F.when(F.lit(False), "")
    for known, kind in FILE_TYPES.items():
        out = out.when(ext == known, kind)
    return out.otherwise("unknown")


def lake_manifest(
    spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, checksum: str | None = None
) -> DataFrame:
    """One row per file; the content is only read when a checksum is asked for.

    Spark's file source leaves out files without content, so an empty file looks like a missing one.  Files of a
    mounted file system are read piece by piece at any size, others whole (2 GB at most) by Spark's reader.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    columns = [
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.regexp_replace("path", r"/[^/]+$", "").alias("parent"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        _file_type(ext).alias("file_type"),
    ]
    if not checksum:
        return files.select(*columns)
    content = CHECKSUMS[checksum](F.col("content")).alias("checksum")
    return with_checksum(files.select(*columns), checksum) if is_mounted(spark, path) else files.select(*columns, content)


def is_mounted(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open files of this path by themselves."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(hadoop).getUri().getScheme() == "file"


def with_checksum(listed: DataFrame, checksum: str) -> DataFrame:
    """Adds the checksum of each listed file; the task that lists a file reads it in pieces of ``PIECE`` bytes."""
    piece = PIECE

    def digest(path: str) -> str:
        found = hashlib.new(checksum)
        with open(re.sub("^file:/+", "/", path), "rb") as f:
            while block := f.read(piece):
                found.update(block)
        return found.hexdigest()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("checksum", pa.array(map(digest, batch.column("path").to_pylist()), pa.string()))

    return listed.mapInArrow(add, T.StructType([*listed.schema.fields, T.StructField("checksum", T.StringType())]))


def verify_integrity(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected(path, checksum)`` against the files found: present, not empty, checksum as expected.

    A file without an expected checksum only has to be there with some content.
    """
    wanted = expected.select("path", F.col("checksum").alias("expected_checksum"))
    found = wanted.join(manifest, "path", "left")
    same = F.col("expected_checksum").isNull() | F.col("checksum").eqNullSafe(F.col("expected_checksum"))
    exists, filled = F.col("size").isNotNull(), F.coalesce(F.col("size") > 0, F.lit(False))
    return found.select(
        "path", exists.alias("exists"), filled.alias("not_empty"), (exists & filled & same).alias("intact")
    )


def storage_usage(manifest: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("size"), F.lit(0))
    return manifest.agg(
        total.alias("total_bytes"),
        F.count(F.lit(1)).alias("file_count"),
        F.countDistinct("parent").alias("directory_count"),
        F.round(total / 1024**2, 2).alias("total_mb"),
        F.round(total / 1024**3, 3).alias("total_gb"),
    )


def stale_files(manifest: DataFrame, days: int) -> DataFrame:
    """Files not modified for more than ``days`` days (a listing; nothing is deleted)."""
    return manifest.where(F.col("modified") < F.current_timestamp() - F.make_dt_interval(F.lit(days)))
