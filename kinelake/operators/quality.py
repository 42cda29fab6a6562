"""Dataset validation as one long table: ``dataset_id, episode_index, rule, severity, message``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators.aggregates import full_episodes
from kinelake.operators.blocks import EPISODE, dense_index, frame_block, join_summary, short_groups
from kinelake.operators.joins import recoverable
from kinelake.operators.windows import not_increasing
from kinelake.session import stage

REQUIRED_ARTIFACTS = ("episode-info", "frame-data")
ERROR, WARNING = "error", "warning"


def _rows(df: DataFrame, rule: str, message: Column, severity: str = ERROR, episode: bool = True) -> DataFrame:
    return df.select(
        "dataset_id",
        (F.col("episode_index").cast("long") if episode else F.lit(None).cast("long")).alias("episode_index"),
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        message.cast("string").alias("message"),
    )


def _about(text: str) -> Column:
    return F.format_string(f"episode %d {text}", F.col("episode_index"))


def check_manifest(catalog: DataFrame) -> DataFrame:
    """Manifests that could not be read; nothing else is checked for those."""
    return _rows(catalog.where(F.col("error").isNotNull()), "V1", F.col("error"), episode=False)


def check_sequential(episodes: DataFrame, order: str | None = None) -> DataFrame:
    """Episodes whose index is not their place in the manifest.

    ``order`` names the column of manifest places (any rising numbers); by default it is ``position`` where there is one, and
    else the index itself, which shows gaps and repeats only.
    """
    order = order or ("position" if "position" in episodes.columns else "episode_index")
    listed = episodes.select("dataset_id", "episode_index", F.col(order).cast("long").alias("_o"))
    placed = dense_index(listed, ["dataset_id"], ["_o", "episode_index"], frame_block(listed, "_o"), "_place")
    message = F.format_string("episode manifest index %d is not sequential at %d", F.col("episode_index"), F.col("_place"))
    return _rows(placed.where(F.col("_place") != F.col("episode_index")), "V2", message)


def check_artifacts(episodes: DataFrame, files: DataFrame) -> DataFrame:
    """Required artifacts that are not there. ``files``: episode key and ``artifact``."""
    needed = episodes.select(*EPISODE, F.explode(F.array(*[F.lit(a) for a in REQUIRED_ARTIFACTS])).alias("artifact"))
    there = files.where(F.col("artifact").isin(*REQUIRED_ARTIFACTS)).select(*EPISODE, "artifact")
    missing = needed.join(there, [*EPISODE, "artifact"], "left_anti")
    return _rows(missing, "V3", F.concat(F.lit("missing "), F.col("artifact")))


def check_joint_order(episodes: DataFrame, datasets: DataFrame) -> DataFrame:
    expected = datasets.select("dataset_id", F.col("joint_names").alias("_expected"))
    differs = episodes.join(expected, ["dataset_id"]).where(~F.col("joint_names").eqNullSafe(F.col("_expected")))
    return _rows(differs, "V4", _about("has its joints in another order than the dataset"))


def check_timestamps(frames: DataFrame) -> DataFrame:
    return _late(not_increasing(frames).select(*EPISODE).distinct())


def _late(episodes: DataFrame) -> DataFrame:
    return _rows(episodes, "V5", _about("has timestamps that do not rise"))


def check_counts(episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Declared frames against the rows there are; an episode without frame data is V3's matter."""
    return _miscounted(episodes, full_episodes(frames).withColumnRenamed("frames", "_rows"))


def _miscounted(episodes: DataFrame, counts: DataFrame) -> DataFrame:
    off = episodes.join(counts, list(EPISODE)).where(F.coalesce("frames", F.lit(0)) != F.col("_rows"))
    return _rows(off, "V6", _about("has another number of rows than frames"))


def check_cameras(episodes: DataFrame, files: DataFrame) -> DataFrame:
    """Declared cameras without a media file. ``files``: episode key and ``camera``."""
    declared = episodes.select(*EPISODE, F.explode("cameras").alias("camera"))
    missing = declared.join(files.select(*EPISODE, "camera"), [*EPISODE, "camera"], "left_anti")
    return _rows(missing, "V7", F.format_string("episode %d has no video of camera %s", F.col("episode_index"), F.col("camera")))


def check_width(frames: DataFrame) -> DataFrame:
    """Episodes with a vector that is not as wide as its joint list."""
    return _misshapen(frames.groupBy(*EPISODE).agg(F.bool_or(_off_width()).alias("_off")).where("_off"))


def _off_width() -> Column:
    width = F.size("joint_names")
    return reduce(lambda a, b: a | b, [F.size(c) != width for c in ("observation_state", "action", "leader_state")])


def _misshapen(episodes: DataFrame) -> DataFrame:
    return _rows(episodes, "V7", _about("has vectors of the wrong width"))


def episode_checks(frames: DataFrame) -> DataFrame:
    """What the checks of frames want to know of each episode: ``_rows``, ``_off`` (a wrong width) and ``_late`` (a timestamp that
    does not rise). Where all episodes are short, one shuffle of slim rows by episode serves all three."""
    slim = frames.select(*EPISODE, "frame_index", "timestamp", _off_width().alias("_off"))
    facts = [F.count(F.lit(1)).alias("_rows"), F.bool_or("_off").alias("_off")]
    if short_groups(frames, EPISODE):
        whole = Window.partitionBy(*EPISODE).orderBy("frame_index", "timestamp")
        stepped = slim.withColumn("_late", F.lag("timestamp").over(whole) >= F.col("timestamp"))
        return stage(stepped.groupBy(*EPISODE).agg(*facts, F.bool_or("_late").alias("_late")))
    late = not_increasing(frames).select(*EPISODE).distinct().withColumn("_late", F.lit(True))
    return stage(join_summary(slim.groupBy(*EPISODE).agg(*facts), late, EPISODE))


def warn_incomplete(journals: DataFrame, episodes: DataFrame) -> DataFrame:
    """Unfinished runs, one warning each."""
    message = F.concat(F.lit("unfinished run to save or discard: "), F.col("run_id"))
    return _rows(recoverable(journals, episodes), "V8", message, WARNING, episode=False)


def validate(
    catalog: DataFrame, datasets: DataFrame, episodes: DataFrame, frames: DataFrame, files: DataFrame, journals: DataFrame
) -> DataFrame:
    """All checks together. ``files``: episode key, ``artifact``, ``camera`` (NULL but for media files)."""
    media = files.where(F.col("camera").isNotNull())
    checked = episode_checks(frames)
    checks = [
        check_manifest(catalog),
        check_sequential(episodes),
        check_artifacts(episodes, files),
        check_joint_order(episodes, datasets),
        _late(checked.where("_late")),
        _miscounted(episodes.select(*EPISODE, "frames"), checked.select(*EPISODE, "_rows")),
        check_cameras(episodes, media),
        _misshapen(checked.where("_off")),
        warn_incomplete(journals, episodes),
    ]
    return reduce(DataFrame.unionByName, checks)


def validation_report(datasets: DataFrame, violations: DataFrame) -> DataFrame:
    """Errors and warnings per dataset; ``ok`` when there is no error."""
    # Every dataset takes part with a row that counts for nothing, so the violations are worked out once. Those without a dataset
    # are nobody's.
    severity = F.when(F.col("dataset_id").isNotNull(), F.col("severity")).alias("severity")
    everyone = violations.select("dataset_id", severity).unionByName(
        datasets.select("dataset_id", F.lit(None).cast("string").alias("severity"))
    )
    counts = everyone.groupBy("dataset_id").agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings")
    )
    return counts.withColumn("ok", F.col("errors") == 0)
