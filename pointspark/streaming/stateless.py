"""Operators without state on Structured Streaming frames: line parsing, voxel ids and rigid motion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointspark.operators.cluster import Bounds, voxelize
from pointspark.operators.registration import transform
from pointspark.sources.clouds import parse_xyz


def txt_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Points of text files as they arrive: ``(value, x, y, z, ok)``."""
    return parse_xyz(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def moved_voxels(points: DataFrame, pose, bounds: Bounds, cell: float) -> DataFrame:
    """Move points by a pose and give them their voxel; both keep a stream a stream."""
    return voxelize(transform(points, pose), bounds, cell)
