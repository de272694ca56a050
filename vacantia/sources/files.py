"""Document files: content addressing, upload checks and which file is in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.text import col


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as rows; the bytes are read only when a query uses them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def extension(filename: Column | str) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(col(filename), r"[^./]+(\.[^./]*)$", 1))


def content_address(df: DataFrame, content: str = "content", filename: str = "path",
                    folder: str = "resumes") -> DataFrame:
    """sha256, size and a storage key that identical bytes share."""
    return (df.withColumn("sha256", F.sha2(F.col(content), 256))
            .withColumn("bytes", F.octet_length(F.col(content)))
            .withColumn("storage_key",
                        F.concat(F.lit(folder + "/"), "sha256", extension(filename))))


def validate_uploads(df: DataFrame, content: str = "content",
                     filename: str = "filename") -> DataFrame:
    """``problem``: why a file is refused; null when it is fine."""
    size, ext = F.octet_length(F.col(content)), extension(filename)
    pdf_head = F.substring(F.col(content), 1, 5).cast("binary") == F.lit(b"%PDF-")
    return df.withColumn("problem", (
        F.when(size == 0, "empty").when(size > V.MAX_UPLOAD_BYTES, "too large")
        .when(~ext.isin(*V.UPLOAD_EXTENSIONS), "extension")
        .when((ext == ".pdf") & ~pdf_head, "not a pdf")))


def orphan_blobs(kept: DataFrame, removed: DataFrame, key: str = "storage_key") -> DataFrame:
    """Keys of removed references that no kept reference still uses."""
    return removed.select(key).distinct().join(kept.select(key), key, "left_anti")


def active_resume(files: DataFrame, deleted_ids: DataFrame | None = None) -> DataFrame:
    """The file in use per candidate; when the active one was deleted, the newest left takes over.

    A candidate none of whose files was active has no row.
    """
    names = files.columns
    if deleted_ids is None:
        marked = files.withColumn("_gone", F.lit(False))
    else:
        gone = deleted_ids.select("id").distinct().withColumn("_gone", F.lit(True))
        marked = files.join(gone, "id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    order = F.when(~F.col("_gone"), F.struct(F.col("active").cast("int").alias("a"), "uploaded_at", "id"))
    return (marked.groupBy("candidate_id")
            .agg(F.max("active").alias("had_active"),
                 F.max_by(F.struct(*[F.col(c) for c in names]), order).alias("f"))
            .where(F.col("had_active") & F.col("f").isNotNull())
            .select("f.*").withColumn("active", F.lit(True)))
