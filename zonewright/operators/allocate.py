"""Giving whole areas to clusters by majority, and mending what that leaves disconnected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_shares(areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit_id, cluster, share) from areas (unit_id, point_id, area) and labels (point_id, cluster).

    Shares are of the area that any labelled point covers, to 9 places: ties are then ties.
    """
    held = areas.join(labels, "point_id").groupBy("unit_id", "cluster").agg(F.sum("area").alias("area"))
    total = held.groupBy("unit_id").agg(F.sum("area").alias("total"))
    return held.join(total, "unit_id").select("unit_id", "cluster", F.round(F.col("area") / F.when(F.col("total") != 0, F.col("total")), 9).alias("share"))


def majority(shares: DataFrame) -> DataFrame:
    """(unit_id, majority_cluster, majority_share, straddle_score): the largest share, of equal ones the smallest name."""
    best = shares.groupBy("unit_id").agg(F.min(F.struct((-F.col("share")).alias("minus"), "cluster")).alias("best"))
    return best.select("unit_id", F.col("best.cluster").alias("majority_cluster"), (-F.col("best.minus")).alias("majority_share"), (1 + F.col("best.minus")).alias("straddle_score"))


def majority_by_cut(areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, unit_id, majority_cluster, majority_share, straddle_score) of every cut at once: areas (unit_id, point_id, area), labels (k, point_id, cluster)."""
    held = areas.join(labels, "point_id").groupBy("k", "unit_id", "cluster").agg(F.sum("area").alias("area"))
    total = held.groupBy("k", "unit_id").agg(F.sum("area").alias("total"))
    share = F.round(F.col("area") / F.when(F.col("total") != 0, F.col("total")), 9)
    best = held.join(total, ["k", "unit_id"]).groupBy("k", "unit_id").agg(F.min(F.struct((-share).alias("minus"), "cluster")).alias("best"))
    return best.select("k", "unit_id", F.col("best.cluster").alias("majority_cluster"), (-F.col("best.minus")).alias("majority_share"), (1 + F.col("best.minus")).alias("straddle_score"))


def winning_none(labels: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster) that no unit went to."""
    return labels.select("cluster").distinct().join(assigned.select(F.col("majority_cluster").alias("cluster")), "cluster", "left_anti")


def best_neighbour(units: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(unit_id, group_id, shared_edge_metres): the other group with the longest common border, ties to the largest name.

    units (unit_id), edges (unit_a, unit_b, shared_edge_metres), groups (unit_id, group_id).
    """
    both = edges.select(F.col("unit_a").alias("unit_id"), F.col("unit_b").alias("near"), "shared_edge_metres").unionByName(
        edges.select(F.col("unit_b").alias("unit_id"), F.col("unit_a").alias("near"), "shared_edge_metres")
    )
    own = groups.select("unit_id", F.col("group_id").alias("own"))
    theirs = groups.select(F.col("unit_id").alias("near"), "group_id")
    borders = both.join(units.select("unit_id"), "unit_id", "left_semi").join(own, "unit_id").join(theirs, "near").filter("group_id <> own")
    sums = borders.groupBy("unit_id", "group_id").agg(F.sum("shared_edge_metres").alias("metres"))
    best = sums.groupBy("unit_id").agg(F.max(F.struct("metres", "group_id")).alias("best"))
    return best.select("unit_id", F.col("best.group_id").alias("group_id"), F.col("best.metres").alias("shared_edge_metres"))


def region_summary(assigned: DataFrame, parts: DataFrame) -> DataFrame:
    """(group_id, members, n, connected, highest_straddle, mean_straddle) of assigned (unit_id, group_id, straddle_score).

    parts (unit_id, root) are the connected parts within groups; a region is connected if it has a single one.
    """
    joined = assigned.select("unit_id", "group_id", "straddle_score").join(parts.select("unit_id", "root"), "unit_id")
    return joined.groupBy("group_id").agg(
        F.array_join(F.sort_array(F.collect_list("unit_id")), ",").alias("members"),
        F.count("*").alias("n"),
        (F.countDistinct("root") == 1).alias("connected"),
        F.max("straddle_score").alias("highest_straddle"),
        F.avg("straddle_score").alias("mean_straddle"),
    )


def with_parents(children: DataFrame, shares: DataFrame) -> DataFrame:
    """children (id, parent_id, shape), those without a parent given the one that covers most of them.

    shares (child_id, parent_id, share) as area_shares has them; of equal shares the smallest name.
    """
    best = shares.groupBy("child_id").agg(F.min(F.struct((-F.round("share", 9)).alias("minus"), "parent_id")).alias("best"))
    best = best.select(F.col("child_id").alias("id"), F.col("best.parent_id").alias("covering"))
    return children.join(best, "id", "left").withColumn("parent_id", F.coalesce("parent_id", "covering")).drop("covering")


def stranded(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, unit_id) outside the largest connected part of their group (unit_id, root); of equal parts the first stays."""
    sized = parts.join(groups, "unit_id").groupBy("group_id", "root").agg(F.count("*").alias("n"), F.min("unit_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "first"))  # one row a part
    rest = sized.withColumn("rank", rank).filter("rank > 1").select("group_id", "root")
    return parts.join(groups, "unit_id").join(rest, ["group_id", "root"], "left_semi").select("group_id", "unit_id")
