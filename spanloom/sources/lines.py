"""Text files as numbered lines, and dataset manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.joins import anti, join_null_safe

#: Bytes of a file that a manifest reads at once.
MOST_WHOLE = 16 << 20
MARK = b"\xef\xbb\xbf"


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """``file, line_no, line`` of every text file under ``path``.

    Files are read in splits, so one large file is read by many tasks. Lines
    are numbered within their split and shifted by the sizes of the splits
    before it.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    paths = [path] if isinstance(path, str) else list(path)
    raw = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
        F.col("value").alias("line"),
    )
    sizes = raw.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    local = F.row_number().over(Window.partitionBy("file", "__block").orderBy("__at"))
    numbered = join_null_safe(raw.withColumn("__rn", local), offsets, ["file", "__block"], null_safe=False)
    return numbered.select("file", (F.col("__rn") + F.col("__off")).cast("long").alias("line_no"), "line")


def base_name(path: str = "file"):
    return F.regexp_extract(F.url_decode(F.col(path)), r"([^/]+)$", 1)


def drop_lines(lines: DataFrame, excluded: DataFrame, on: str = "file") -> DataFrame:
    """Remove listed ``(file, line_no)`` before parsing."""
    return anti(lines, excluded, [on, "line_no"])


def with_file_options(lines: DataFrame, control: DataFrame, on: str = "file") -> DataFrame:
    """Attach per-file reading options from a control table; unlisted files drop out."""
    return join_null_safe(lines, control, on, "inner")


def manifest(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, whole: int = MOST_WHOLE) -> DataFrame:
    """``file, bytes, md5`` of every file under the paths.

    Files of up to ``whole`` bytes are read at once, larger ones line by line, so
    memory grows with the longest line; large files whose names have no extension
    are read at once too.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    files = reader.format("binaryFile").load(paths)
    # conditions on the listing alone, so no other file is opened
    extension = F.regexp_extract("_metadata.file_name", r".(\.[^.]+)$", 1)
    whole = max(whole, len(MARK))  # a mark alone has no line
    large = (F.col("_metadata.file_size") > whole) & (extension != "")
    found = files.where(~large).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("md5"))
    named = files.where(large).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("__key"), extension.alias("__ext"))
    kinds = sorted(r[0] for r in named.select("__ext").distinct().collect())  # one row per extension
    for kind in kinds:
        # as files of a codec that changes nothing, they are not split and lose no bytes to another codec
        plain = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", "io.compress.passthrough.extension": kind}
        plain |= {f"org.apache.hadoop.shaded.{name}": value for name, value in plain.items()}  # their names in Spark's own Hadoop
        lines = (spark.read.option("pathGlobFilter", glob) if glob else spark.read).options(lineSep="\n", **plain).text(paths)
        lines = lines.where((F.col("_metadata.file_size") > whole) & F.col("_metadata.file_name").endswith(kind))
        each = lines.select(F.col("_metadata.file_path").alias("key"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
        sums = each.mapInArrow(_digests, "__key string, md5 string")
        found = found.unionByName(named.where(F.col("__ext") == kind).join(sums, "__key").select("file", "bytes", "md5"))
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The MD5 of each file from its lines (key, size, line), which come in order, file by file.

    Hadoop's reader drops a byte order mark and does not say whether the last line
    ended; both follow from the size.
    """
    key, size, read, sums = None, 0, 0, []

    def done() -> pa.RecordBatch:
        mark, ended = divmod(size - read, 3)
        if (mark, ended) not in ((0, 0), (0, 1), (1, 0), (1, 1)):
            raise ValueError(f"{key}: {read} of {size} bytes were read")
        if ended:
            sums[mark].update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sums[mark].hexdigest()])], names=["__key", "md5"])

    for batch in batches:
        keys = batch.column(0)
        at = 0
        while at < len(keys):
            here = keys[at].as_py()
            upto = len(keys) if keys[-1].as_py() == here else at + pc.index(pc.not_equal(keys[at:], here), True).as_py()
            if here != key:
                if key is not None:
                    yield done()
                key, size, read, sums = here, batch.column(1)[at].as_py(), -1, [hashlib.md5(), hashlib.md5(MARK)]
            for first in range(at, upto, 1024):
                part = b"\n".join(batch.column(2)[first : min(first + 1024, upto)].to_pylist())
                if read >= 0:
                    part = b"\n" + part
                read = max(read, 0) + len(part)
                for x in sums:
                    x.update(part)
            at = upto
    if key is not None:
        yield done()


def table_shape(df: DataFrame, name: str) -> DataFrame:
    """Name, rows and columns of one table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))
