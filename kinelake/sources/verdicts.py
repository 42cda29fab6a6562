"""The log of verdicts: appended per evaluation, the last one of an episode counts, compacted now and then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators.blocks import EPISODE
from kinelake.sources import commits

TABLE = "verdicts"
REVISION = "revision"


def write_back(verdicts: DataFrame, root: str, at: Column | None = None) -> commits.Snapshot:
    """Append the verdicts of one evaluation, one row per episode, as the next revision of the log.

    The revision is the version that the commit makes, so of two evaluations of an episode the one that committed later counts,
    whatever the clocks say. Rows of all episodes are written in one commit or not at all; no other field of an episode changes.
    """
    spark = verdicts.sparkSession
    stamped = verdicts if at is None else verdicts.withColumn("ts", at)

    def change(base: commits.Snapshot) -> commits.Snapshot:
        return commits.commit(spark, base, {TABLE: stamped.withColumn(REVISION, F.lit(base.version + 1).cast("long"))})

    return commits.transact(spark, root, change)


def revisions(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """All rows of the log as of a version; None while nothing has been written."""
    paths = commits.snapshot(spark, root, version).paths(TABLE)
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def newest(log: DataFrame) -> DataFrame:
    """The last revision of each episode: a partial aggregate, whatever the number of revisions."""
    others = [c for c in log.columns if c not in EPISODE]
    last = log.groupBy(*EPISODE).agg(F.max_by(F.struct(*others), REVISION).alias("_v"))
    return last.select(*EPISODE, *[F.col("_v")[c].alias(c) for c in others])


def compact(spark: SparkSession, root: str) -> commits.Snapshot:
    """Replace the log by its last revisions; earlier versions stay readable until they are swept."""

    def change(base: commits.Snapshot) -> commits.Snapshot | None:
        log = revisions(spark, root, base.version)
        if log is None or len(base.tables[TABLE]) < 2:
            return None
        return commits.commit(spark, base, {TABLE: newest(log)}, replace=(TABLE,))

    return commits.transact(spark, root, change)


def with_evaluation(episodes: DataFrame, root: str, version: int | None = None) -> DataFrame:
    """Episodes with their last verdict as a nested ``evaluation`` (null where there is none); all other fields unchanged."""
    log = revisions(episodes.sparkSession, root, version)
    if log is None:
        return episodes.withColumn("evaluation", F.lit(None).cast("struct<success:boolean>"))
    last = newest(log)
    body = F.struct(*[c for c in last.columns if c not in (*EPISODE, REVISION)])
    return episodes.join(last.select(*EPISODE, body.alias("evaluation")), list(EPISODE), "left")
