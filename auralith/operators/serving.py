"""What the service answers, as DataFrames; toJSON() makes the bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralith.operators import catalog
from auralith.operators.clustering import centroids_2d, project_2d


def samples(tables: dict[str, DataFrame], q: str = "", tag: str = "") -> DataFrame:
    """Samples with their tags; with a tag those that carry it, with q those whose path or name holds it."""
    own = catalog.samples_by_tag(tables["samples"], tables["tags"], tables["sample_tags"], tag) if tag.strip() else tables["samples"]
    found = catalog.search(own, q) if q.strip() else own
    return catalog.samples_with_tags(found, tables["tags"], tables["sample_tags"]).orderBy("path")


def sample(tables: dict[str, DataFrame], sample_id: int) -> DataFrame:
    return catalog.samples_with_tags(catalog.sample_by_id(tables["samples"], sample_id), tables["tags"], tables["sample_tags"])


def tags(tables: dict[str, DataFrame]) -> DataFrame:
    return catalog.tag_usage(tables["tags"], tables["sample_tags"])


def clusters(tables: dict[str, DataFrame], method: str = "kmeans", projection: str = "tsne", points: DataFrame | None = None) -> DataFrame:
    """(id, method, label, size, projection_x, projection_y, members array of (sample_id, score, x, y)) of a method.

    points (sample_id, x, y) may be a stored projection; else all vectors of the analysis are projected."""
    own = catalog.clusters_with_size(tables["clusters"], tables["cluster_members"], method)
    if points is None:
        points = project_2d(catalog.vectors_in(tables["feature_vectors"], "analysis"), projection)
    members = tables["cluster_members"].join(own.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").join(points, "sample_id", "left")
    listed = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "score", "x", "y"))).alias("members"))
    centres = centroids_2d(tables["cluster_members"], points).drop("n")
    return own.join(centres, own["id"] == centres["cluster_id"], "left").drop("cluster_id").join(listed, own["id"] == listed["cluster_id"], "left").drop("cluster_id").orderBy("id")


def cluster(tables: dict[str, DataFrame], cluster_id: int, points: DataFrame | None = None) -> DataFrame:
    """One cluster of either method."""
    method = tables["clusters"].where(F.col("id") == cluster_id).select("method").first()
    if method is None:
        raise LookupError(f"cluster {cluster_id} not found")
    return clusters(tables, method["method"], points=points).where(F.col("id") == cluster_id)
