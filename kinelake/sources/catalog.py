"""Dataset manifests: one JSON document per dataset, bad ones kept as rows with an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.schema import KIND_DATASET, MANIFEST, SCHEMA_VERSION


def parse_manifests(texts: DataFrame) -> DataFrame:
    """``path, value`` to manifest rows; ``error`` names what is wrong with an unreadable one."""
    parsed = texts.select("path", F.from_json("value", MANIFEST, {"mode": "PERMISSIVE"}).alias("m"))
    kind, version = F.col("m.kind"), F.col("m.schema_version")
    error = (
        F.when(F.col("m").isNull() | (kind.isNull() & F.col("m.dataset_id").isNull()), "manifest is not readable JSON")
        .when(kind.isNull() | (kind != KIND_DATASET), "not an episode dataset manifest")
        .when(version.isNull() | (version != SCHEMA_VERSION), "unsupported manifest version")
    )
    return parsed.select("path", "m.*", error.alias("error"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Manifests under a root. ``path`` may hold globs, as in ``root/*/dataset.json``."""
    texts = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_manifests(texts)


def catalog_datasets(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("error").isNull()).select(
        "dataset_id", "path", "fps", "task", "robot_type", "metadata", "created_at", "updated_at",
        F.col("features.joint_names").alias("joint_names"), F.col("features.units").alias("units"),
        F.coalesce(F.map_keys("features.cameras"), F.array().cast("array<string>")).alias("cameras"),
    )


def catalog_episodes(catalog: DataFrame) -> DataFrame:
    """Manifest entries with their place in the manifest."""
    return catalog.where(F.col("error").isNull()).select(
        "dataset_id", F.posexplode("episodes").alias("position", "e")
    ).select("dataset_id", "position", "e.*")
