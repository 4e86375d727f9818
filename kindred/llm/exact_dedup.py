"""Exact dedup with a persistent digest index, bucketed and sorted by hash.

``DigestIndex`` is a Parquet table of one row per distinct text: ``digest`` (SHA-256), ``keep_id``
and ``batch``. It is bucketed by ``digest`` and sorted within buckets, so that a batch of new data
meets it in a sort-merge join with no exchange of the index. ``add`` dedups a batch:

1. the batch is reduced to one row per digest (map-side combine first, so a text that a third of
   all rows share costs one row per task),
2. a sort-merge anti-join against the index finds digests that are new, which are appended,
3. every row of the batch is told which row stays.

Only DataFrame functions run on this path.

Defined results: a null text counts as the empty text. Of equal texts in one batch the row with
the largest id stays; a null id stays only where all ids of the text are null. Rows that repeat an
id and a text: one of them stays. Digests that an earlier batch brought keep that batch's row. An
empty table gives an empty result. Extra columns are neither read nor returned.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import fresh_path, materialise

#: Digests that hold at least this share of the batch are joined by broadcast: at most 1/share rows.
HOT_SHARE = 1 / 1000


def digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


class DigestIndex:
    """A digest index at ``path``; it is made when first added to, and can be opened again."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "digests")
        self.buckets = self._bucket_count(buckets)
        self.name = "digests_" + uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def _bucket_count(self, asked: int | None) -> int:
        """The count the index was written with, kept beside it; a new index takes ``asked`` or the session's."""
        beside = f"{self.path}.buckets"
        try:
            found = self.spark.read.schema("buckets int").parquet(beside).first()
        except AnalysisException:
            found = None
        if found is None:
            count = asked or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.spark.range(1, numPartitions=1).select(F.lit(count).alias("buckets")).write.mode("overwrite").parquet(beside)
            return count
        if asked and asked != found["buckets"]:
            raise ValueError(f"{self.path} has {found['buckets']} buckets, not {asked}")
        return found["buckets"]

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Dedup ``docs`` against the index and within itself; append what is new.

        Returns (doc_id, digest, nth, keep_id, group_size, kept) per row. ``group_size`` counts
        rows of this batch. A caller that names its ``batch`` can add it again after a failure: what the
        first try appended counts as this batch's own, so nothing is appended twice and the same rows stay.
        """
        batch = batch or uuid.uuid4().hex
        same = W.partitionBy("digest", "doc_id").orderBy("doc_id")
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest"))
        rows = materialise(rows.withColumn("nth", F.row_number().over(same)), "rows")
        groups = materialise(
            rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
        )
        fresh = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", "keep_id", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        known = self.table().hint("merge").join(groups.select("digest", "group_size"), "digest")
        known = known.select("digest", "keep_id", "batch", "group_size")
        total = groups.agg(F.sum("group_size")).first()[0] or 0
        bar = max(2, total * HOT_SHARE)
        hot = F.broadcast(known.filter(F.col("group_size") >= bar))
        rest = known.filter(F.col("group_size") < bar)
        told = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(rest, "digest"))
        return told.select(
            "doc_id",
            "digest",
            "nth",
            "keep_id",
            "group_size",
            ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias(
                "kept"
            ),
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    told = (index or DigestIndex(docs.sparkSession)).add(docs)
    return told.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with all their columns.

    A repeated (id, text) row is let through once: rows that match a kept id and digest are
    numbered, on those few keys alone. The input row travels as one struct, so its columns may have any
    names but that of each other.
    """
    told = (index or DigestIndex(docs.sparkSession)).add(docs)
    twice = told.groupBy("digest", "doc_id").agg(F.max("nth").alias("times"), F.max("kept").alias("kept"))
    kept = twice.filter("kept").select(F.col("digest").alias("kept_digest"), F.col("doc_id").alias("kept_id"), "times")
    marked = docs.select(F.struct(*docs.columns).alias("row"))
    marked = marked.select("row", digest(F.col("row.text")).alias("digest"), F.col("row.doc_id").cast("long").alias("id"))
    joined = marked.join(kept, (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")))
    once = joined.filter("times = 1").select("row.*")
    again = joined.filter("times > 1").dropDuplicates(["digest", "id"]).select("row.*")
    return once.unionByName(again)
