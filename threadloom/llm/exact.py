"""Exact deduplication of new documents against an immutable snapshot (operator 10).

The snapshot's digests are cut into buckets of about 64,000; each bucket has a static binary fuse filter. Incoming digests are
first grouped among themselves, which takes copies inside the batch together and leaves one row a digest, then screened by the
filter of their bucket. Only what a filter lets through is joined with the snapshot's digests. Rows whose digest occurs more than
once are compared byte for byte with one text of their group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm import fuse
from threadloom.llm.common import small_side
from threadloom.session import cut_lineage

KEYS_PER_FILTER = 65_536
#: Tables of repeated digests up to this many rows (about 50 bytes each) go to every task; larger ones are joined by a shuffle.
BROADCAST_DIGESTS = 200_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def snapshot_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, filter)`` from distinct ``digest`` values."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [fuse.build(pdf["key"].to_numpy().astype(np.uint64))]})

    return _keyed(digests, buckets).select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket long, filter binary")


def screened(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``(digest, maybe)``: whether the snapshot's filter may hold a distinct digest. False is certain."""
    def look(pdf: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        blob = stored["filter"].iloc[0] if len(stored) else b""
        return pd.DataFrame({"digest": pdf["digest"], "maybe": fuse.holds(blob, pdf["key"].to_numpy().astype(np.uint64))})

    return _keyed(digests, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(look, "digest binary, maybe boolean")


def _keyed(digests: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return digests.select("digest", key.alias("key"), F.pmod(F.shiftrightunsigned(key, 7), F.lit(buckets)).cast("long").alias("bucket"))


def exact_groups(docs: DataFrame, in_snapshot: Column, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)``, one row per row of ``docs``: groups of equal texts.

    ``in_snapshot`` says which rows are already there; the others are the new batch. The row with the largest ``doc_id`` of a group
    stays, and of rows that share this id one. ``group_size`` counts rows. A null text is equal to an empty one. A null ``doc_id``
    stays only if its group has no other. ``digest`` may collide: the byte check tells such texts apart. An empty table gives no
    rows; other columns are not used.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(in_snapshot, F.lit(False)).alias("_old")).withColumn("digest", digest(F.col("text")))
    rows = cut_lineage(texts.groupBy("doc_id", "digest", "_old").agg(F.count(F.lit(1)).alias("n")))
    sums = [F.sum("n").alias("n"), F.max("doc_id").alias("keep_id")]
    old = cut_lineage(rows.filter("_old").groupBy("digest").agg(*sums))
    new = cut_lineage(rows.filter(~F.col("_old")).groupBy("digest").agg(*sums))
    buckets = max(1, math.ceil(max(old.count(), new.count()) / KEYS_PER_FILTER))

    flags = screened(new.select("digest"), snapshot_filters(old.select("digest"), buckets), buckets)
    maybe = flags.filter("maybe").select("digest").join(new, "digest")
    met = maybe.join(old.select("digest"), "digest", "left_semi").select("digest")
    # Digests with more than one row: copies inside the batch, copies inside the snapshot, and those that the join found.
    again = cut_lineage(new.filter("n > 1").select("digest").unionByName(old.filter("n > 1").select("digest")).unionByName(met).distinct())
    repeated = small_side(again, BROADCAST_DIGESTS)

    single = rows.join(repeated, "digest", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), "n", F.col("n").alias("group_size"), "digest")
    return _one_row_each(single.unionByName(_byte_checked(texts, repeated)))


def _byte_checked(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Groups of repeated digests, told apart by text where it differs from the text of the group's first row."""
    members = cut_lineage(texts.select("doc_id", "digest", "text").join(repeated, "digest"))
    first = members.groupBy("digest").agg(F.min("doc_id").alias("_id"))
    model = members.join(first, "digest").filter(F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("digest").agg(F.min("text").alias("_text"))
    told = members.join(model, "digest").select("doc_id", "digest", F.when(F.col("text") != F.col("_text"), F.col("text")).alias("_other"))
    rows = cut_lineage(told.groupBy("doc_id", "digest", "_other").agg(F.count(F.lit(1)).alias("n")))
    groups = rows.groupBy("digest", "_other").agg(F.sum("n").alias("group_size"), F.max("doc_id").alias("keep_id"))
    side = groups.select(F.col("digest").alias("_d"), F.col("_other").alias("_o"), "group_size", "keep_id")
    return rows.join(side, (F.col("digest") == F.col("_d")) & F.col("_other").eqNullSafe(F.col("_o"))).select("doc_id", "keep_id", "n", "group_size", "digest")


def _one_row_each(groups: DataFrame) -> DataFrame:
    """Back to one row per row; of rows with the id that stays, the first is kept."""
    spread = groups.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i"))
    kept = (F.col("_i") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return spread.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")
