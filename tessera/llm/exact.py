"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one stable id.

One pass over the texts writes each row's content hash, SHA-256 and length; classes are hash aggregates of those rows,
combined in each map task, so copies never meet as rows. A second pass compares the bytes of classes with more than
one row, combining equal texts in each map task: two different texts under both hashes raise an error instead of
being merged. Texts of single rows are not shuffled as long as the classes to compare leave slots free.

Defined results: a null text is the empty text; the longest original stays, then the smallest doc_id, then any id
before a null one; of rows that agree in text, length and doc_id one is kept; an empty table gives no rows; other
columns pass by unused. doc_id is an integer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, text_or_empty

#: Bounds of the two broadcasts: slots of hashes to compare, and classes that hold at least this part of all rows.
SLOTS, HOT_PART = 1 << 18, 1000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=F.md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    content_hash is a parameter so that tests can force collisions.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("t")).select(
        "doc_id", F.length("t").alias("n"), F.translate("t", SPACES, "").alias("norm")
    )
    hashes = F.unhex(content_hash("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")
    rows = materialise(base.select("doc_id", "n", *hashes, F.monotonically_increasing_id().alias("at")), "exact-rows")
    best = F.max(F.struct(F.col("n"), F.bitwise_not("doc_id").alias("inv"), (-F.col("at")).alias("first"))).alias("best")
    classes = materialise(rows.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("size"), best), "exact-classes")
    _compare_bytes(base, classes, content_hash)
    total = rows.count()
    # at most HOT_PART classes can hold so many rows: these are joined without a shuffle
    large = F.broadcast(classes.where(F.col("size") * HOT_PART >= max(total, 1)))
    few = rows.join(large, ["h", "sha"])
    rest = rows.join(large, ["h", "sha"], "left_anti").join(classes, ["h", "sha"])
    return few.unionByName(rest).select(
        "doc_id",
        F.bitwise_not("best.inv").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("at") == -F.col("best.first")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _compare_bytes(base: DataFrame, classes: DataFrame, content_hash) -> None:
    """Raise if a class holds two texts."""
    slot = lambda h: F.pmod(F.xxhash64(h), F.lit(SLOTS))
    shared = classes.where("size > 1")
    asked = F.broadcast(shared.select(slot("h").alias("slot")).distinct())
    some = base.select("norm", F.unhex(content_hash("norm")).alias("h")).withColumn("slot", slot("h")).join(asked, "slot", "left_semi")
    texts = some.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "norm").distinct()
    if not texts.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).isEmpty():
        raise ValueError("two different texts share both content hash and SHA-256")
