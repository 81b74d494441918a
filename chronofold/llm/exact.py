"""Exact deduplication in three combining steps, all of them DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import SPACE_CLASS, Scratch, text_of, whole_row


def normalised(text: str = "text") -> Column:
    """Every run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(text_of(text), SPACE_CLASS, " ")


def _digested(docs: DataFrame, text: str, key: str, digest) -> DataFrame:
    """(_key, _content, _digest); the digest can't be null, so joins on it add no filter that takes it twice."""
    rows = docs.select(F.col(key).alias("_key"), normalised(text).alias("_content"))
    return rows.withColumn("_digest", F.coalesce(digest(F.col("_content")), F.lit("")))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def combined(docs: DataFrame, scratch: Scratch, text: str, key: str, salts: int, digest=sha256) -> DataFrame:
    """(_digest, _check, _low, _n): a row for each different content, as a written table.

    1. Locally: the partial aggregate of step 2 folds equal texts of a task before the shuffle.
    2. Salted: texts meet by (digest, salt, content), so a text that a third of all rows share is
       combined in ``salts`` tasks and each sends on one row.
    3. Globally: salt winners meet by (digest, content).

    The content itself is a grouping key in every step: texts whose digests collide stay apart.
    """
    salted = (
        _digested(docs, text, key, digest)
        .withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"))
        .groupBy("_digest", "_salt", "_content")
        .agg(F.min("_key").alias("_low"), F.count("*").alias("_n"))
    )
    groups = salted.groupBy("_digest", "_content").agg(F.min("_low").alias("_low"), F.sum("_n").alias("_n"))
    groups = scratch.table("groups", groups.select("_digest", F.xxhash64("_content").alias("_check"), "_low", "_n"))
    return groups


def exact_groups(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", salts: int = 16, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    After ``combined``, membership returns by digest; digests that stand for several contents (none
    with SHA-256, but ``digest`` is a parameter) return by a hash of the content as well.

    Empty table: no rows.  Null text: as the empty text.  Null key: counted; it stays only where
    the whole group has null keys, and then keep_id is null.  Rows repeated with one key: all
    count, and all of them are marked kept if that key is the smallest.  Other columns are ignored.
    """
    groups = combined(docs, scratch, text, key, salts, digest)
    by_digest = groups.groupBy("_digest").agg(F.min("_low").alias("_low"), F.sum("_n").alias("_n"), F.count("*").alias("_contents"))
    ids = _digested(docs, text, key, digest).select("_key", "_digest", F.xxhash64("_content").alias("_check"))
    if by_digest.where("_contents > 1").isEmpty():
        # Written before the join: both sides are then plain exchanges, whose hot partitions Spark splits.
        joined = ids.drop("_check").join(scratch.table("winners", by_digest.drop("_contents")), "_digest")
    else:
        joined = ids.join(groups, ["_digest", "_check"])
    return joined.select(
        F.col("_key").alias(key),
        F.col("_low").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.col("_key").eqNullSafe(F.col("_low")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest key, whole and unchanged.

    Of rows repeated with the same key and an equal text one stays.
    """
    kept = combined(docs, scratch, text, key, salts).select(F.xxhash64("_low").alias("_k"), "_digest", "_low")
    digest = F.coalesce(sha256(normalised(text)), F.lit(""))
    rows = docs.select(whole_row(docs), F.col(key).alias("_key"), F.xxhash64(key).alias("_k"), digest.alias("_digest"))
    # Written so that it is no join key: the join then leaves rows placed and sorted by the two that
    # are, and picking one of repeated rows shuffles nothing more.
    same = F.coalesce(F.col("_key") == F.col("_low"), F.col("_key").isNull() & F.col("_low").isNull())
    stay = rows.join(kept, ["_k", "_digest"]).where(same)
    return stay.dropDuplicates(["_k", "_digest"]).select("_row.*")
