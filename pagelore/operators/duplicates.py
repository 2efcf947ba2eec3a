"""Exact and near duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.operators import vectors
from pagelore.schema import NEAR_DUP_NEIGHBOURS, NEAR_DUP_THRESHOLD


def exact_groups(slides: DataFrame, key: str = "id", hash_col: str = "content_hash") -> DataFrame:
    """group (its smallest id), members ascending, n: slides with one content hash; largest first is an order for the caller."""
    rows = slides.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.sort_array(F.collect_list(key)).alias("members"))
    return rows.where(F.size("members") > 1).select(F.element_at("members", 1).alias("group"), "members", F.size("members").alias("n"))


def exact_members(slides: DataFrame, key: str = "id", hash_col: str = "content_hash") -> DataFrame:
    """group and key, one row a member: the form for groups of any size."""
    heads = slides.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(key).alias("group"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return slides.join(heads, hash_col).select("group", key)


def all_same(members: DataFrame, slides: DataFrame) -> DataFrame:
    """cluster, same: whether all members have one content hash and none lacks it."""
    rows = members.join(slides.select(F.col("id").alias("slide_id"), "content_hash"), "slide_id")
    return rows.groupBy("cluster").agg(((F.count_distinct("content_hash") == 1) & (F.count("content_hash") == F.count(F.lit(1)))).alias("same"))


def near_groups(slides: DataFrame, store: DataFrame, threshold: float = NEAR_DUP_THRESHOLD, top: int = NEAR_DUP_NEIGHBOURS, clusters: DataFrame | None = None) -> DataFrame:
    """cluster, slide_id, cohesion of near-duplicate clusters that are not merely exact copies. clusters: those of the store, if they are known."""
    members = vectors.work_table(vectors.clusters(store, threshold, top), "clusters") if clusters is None else clusters
    real = all_same(members, slides).where(~F.col("same")).select("cluster")
    kept = members.join(real, "cluster", "left_semi")
    return kept.join(vectors.cohesion(kept, store), "cluster")


def groups(slides: DataFrame, decks: DataFrame, store: DataFrame | None, threshold: float = NEAR_DUP_THRESHOLD, clusters: DataFrame | None = None) -> DataFrame:
    """kind, group, n, score, members (newest deck first, then id), ordered exact before near, large before small."""
    exact = exact_members(slides).select(F.lit("exact").alias("kind"), "group", F.col("id").alias("slide_id"), F.lit(None).cast("float").alias("score"))
    if store is not None:
        near = near_groups(slides, store, threshold, clusters=clusters)
        exact = exact.unionByName(near.select(F.lit("near").alias("kind"), F.col("cluster").alias("group"), "slide_id", F.col("cohesion").alias("score")))
    rows = exact.join(slides.select(F.col("id").alias("slide_id"), "deck_id", "slide_index", "title"), "slide_id").join(decks.select(F.col("id").alias("deck_id"), "path", "modified_unix"), "deck_id")
    member = F.struct((-F.col("modified_unix")).alias("newest"), "slide_id", "path", "slide_index", "title")
    out = rows.groupBy("kind", "group").agg(F.count(F.lit(1)).alias("n"), F.first("score").alias("score"), F.sort_array(F.collect_list(member)).alias("members"))
    return out.withColumn("members", F.transform("members", lambda m: m.dropFields("newest"))).orderBy("kind", F.desc("n"), "group")
