"""Robot-episode views over the given tables, and the same views as SQL text.

``frames_events``   one episode per user, one frame per event;
``frames_lines``    one episode per supplier, one frame per line item;
``frames_vec``      wide vectors from the embeddings;
``points``          paths in space from the embeddings;
``samples`` / ``camera_frames``   ingest streams from the events;
``datasets`` / ``episodes`` / ``frames_orders``   manifests and their frames from nations, orders and line items.
"""

from __future__ import annotations

import os
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import scalars as X
from kinelake.operators.blocks import dense_index, running_total, short_groups, with_neighbours
from kinelake.plans.registry import cte
from kinelake.schema import KIND_SAMPLE
from kinelake.session import block_rows, shared_folder, stage
from kinelake.sources import keyed as K

JOINTS = ("shoulder", "elbow", "gripper")
EVENTS_DATASET = "events-demo"
EVENTS_FPS = 30
OPEN, SHUT = 0.9, 0.05
STALE_SECONDS = 86400.0


def is_open(key):
    """Whether the recording of an order is still open; its key alone says so, so lines are told apart before they meet their orders."""
    return key % 50 == 0


def f32(col):
    """A value as it reads back from single-precision storage."""
    return col.cast("float").cast("double")


_STAGED: dict[tuple[str, str, str], DataFrame] = {}
_KEYED: dict[tuple[str, str], K.KeyedFrames] = {}


def staged_view(build):
    """A view that is written once per application, as an ingested table would be, and then scanned by every query."""

    def view(self: Tables) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.root, build.__name__)
        if key not in _STAGED or not still_there(_STAGED[key]):
            _STAGED[key] = stage(build(self))
        return _STAGED[key]

    view.__name__ = build.__name__
    view.build = build
    return cached_property(view)


def still_there(df: DataFrame) -> bool:
    """Temporary folders of a local run may be cleared at any time."""
    files = df.inputFiles()
    return not files or not files[0].startswith("file:") or os.path.exists(files[0].removeprefix("file:").replace("///", "/"))


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        # Clock times in the tables carry no zone; both engines read them as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        ns = X.timestamp_to_ns(F.col("ts").cast("timestamp"))
        return self("events").select(
            "event_id", "user_id", "event_type", "value", "ts", k.alias("k"), ns.alias("captured_at_ns")
        )

    @staged_view
    def frames_events(self) -> DataFrame:
        day = F.floor(F.col("captured_at_ns") / F.lit(86_400_000_000_000)).cast("long")
        opened = F.col("event_type").isin("purchase", "signup", "error")
        commanded = ~F.col("event_type").isin("click", "view") & (F.col("value") < 60)
        flat = self.events.select(
            F.lit(EVENTS_DATASET).alias("dataset_id"),
            F.col("user_id").alias("episode_index"),
            F.col("event_id").alias("sample_sequence"),
            "captured_at_ns",
            (F.col("captured_at_ns") + F.col("k") * 1_000_000).alias("recorded_at_ns"),
            F.concat(F.lit("task-"), F.col("user_id") % 3).alias("task"),
            (F.col("value") / 100).cast("float").alias("o0"),
            (F.col("k") / F.lit(100.0)).cast("float").alias("o1"),
            F.when(opened, OPEN).otherwise(SHUT).cast("float").alias("o2"),
            F.when(commanded, OPEN).otherwise(SHUT).cast("float").alias("a2"),
        )
        # event_id is the (ts, event_id) rank, so it orders a user's events by itself.
        short = short_groups(self("events"), ["user_id"])
        indexed = dense_index(flat, ["dataset_id", "episode_index"], ["sample_sequence"], day, "frame_index", short)
        stepped = with_neighbours(
            indexed,
            0,
            1,
            {
                "a0": lambda w: F.coalesce(F.lead("o0").over(w), F.col("o0")),
                "a1": lambda w: F.coalesce(F.lead("o1").over(w), F.col("o1")),
            },
            short=short,
        )
        return stepped.select(
            "dataset_id",
            "episode_index",
            F.concat(F.lit("ep-"), F.col("episode_index")).alias("episode_id"),
            "frame_index",
            (F.col("frame_index") / F.lit(30.0)).cast("float").alias("timestamp"),
            "recorded_at_ns",
            "captured_at_ns",
            "sample_sequence",
            "task",
            F.array(*[F.lit(j) for j in JOINTS]).alias("joint_names"),
            F.array("o0", "o1", "o2").alias("observation_state"),
            F.array("a0", "a1", "a2").alias("action"),
            F.array("a0", "a1", "a2").alias("leader_state"),
        )

    @cached_property
    def keyed_events(self) -> K.KeyedFrames:
        """``frames_events`` laid out by key, once per application."""
        key = (self.spark.sparkContext.applicationId, self.root)
        if key not in _KEYED or not still_there(_KEYED[key].frames):
            root = f"{shared_folder(self.spark)}/keyed-{uuid.uuid4().hex}"
            K.write_keyed(self.frames_events, root, buckets=32, run=64)
            _KEYED[key] = K.read_keyed(self.spark, root)
        return _KEYED[key]

    @staged_view
    def frames_lines(self) -> DataFrame:
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        block = F.floor(F.col("l_orderkey") / 65536).cast("long")
        short = short_groups(self("lineitem"), ["l_suppkey"])
        indexed = dense_index(self("lineitem"), ["l_suppkey"], order, block, "frame_index", short)
        flat = indexed.select(
            F.lit("lines-demo").alias("dataset_id"),
            F.col("l_suppkey").alias("episode_index"),
            "frame_index",
            (F.col("l_quantity") / 50).cast("float").alias("o0"),
            F.col("l_discount").cast("float").alias("o1"),
            F.col("l_tax").cast("float").alias("o2"),
            F.when(F.col("l_linestatus") == "O", OPEN).otherwise(SHUT).cast("float").alias("o3"),
            F.when(F.col("l_returnflag") == "N", OPEN).otherwise(SHUT).cast("float").alias("a3"),
        )
        nxt = {f"a{j}": (lambda w, j=j: F.coalesce(F.lead(f"o{j}").over(w), F.col(f"o{j}"))) for j in range(3)}
        return with_neighbours(flat, 0, 1, nxt, short=short).select(
            "dataset_id",
            "episode_index",
            "frame_index",
            (F.col("frame_index") / F.lit(30.0)).cast("float").alias("timestamp"),
            F.array(*[F.lit(j) for j in ("base", "lift", "wrist", "gripper")]).alias("joint_names"),
            F.array("o0", "o1", "o2", "o3").alias("observation_state"),
            F.array("a0", "a1", "a2", "a3").alias("action"),
            F.array("a0", "a1", "a2", "a3").alias("leader_state"),
        )

    @staged_view
    def frames_vec(self) -> DataFrame:
        block = F.floor(F.col("vec_id") / 65536).cast("long")
        flat = self("embeddings").select(
            F.lit("vec-demo").alias("dataset_id"),
            F.col("label").cast("long").alias("episode_index"),
            "vec_id",
            F.col("embedding").alias("observation_state"),
        )
        return dense_index(flat, ["dataset_id", "episode_index"], ["vec_id"], block, "frame_index")

    @cached_property
    def points(self) -> DataFrame:
        spike = F.when(F.col("vec_id") % 17 == 0, 50.0).otherwise(1.0)
        axes = [
            (F.get("observation_state", F.lit(i)).cast("double") * 100.0 * spike).alias(n) for i, n in enumerate("xyz")
        ]
        return self.frames_vec.select("dataset_id", "episode_index", "frame_index", *axes)

    @cached_property
    def samples(self) -> DataFrame:
        stream = self.events.where(~F.col("event_type").isin("view", "click"))
        value, k = F.col("value") / 100, F.col("k") / F.lit(100.0)
        joints = F.map_from_arrays(
            F.array(*[F.lit(j) for j in JOINTS]), F.array(f32(value), f32(k), f32(F.lit(OPEN)))
        )
        return stream.select(
            F.col("user_id").alias("run_id"),
            F.lit(KIND_SAMPLE).alias("kind"),
            F.col("event_id").alias("sequence"),
            "captured_at_ns",
            F.array(*[F.lit(j) for j in JOINTS]).alias("joint_names"),
            joints.alias("leader"),
            joints.alias("observation"),
            joints.alias("action"),
            F.lit("radians").alias("units"),
            (F.col("event_type") != "error").alias("armed"),
            (F.col("value") >= 1).alias("live"),
        )

    @cached_property
    def camera_frames(self) -> DataFrame:
        stream = self.events.where(F.col("event_type").isin("view", "click"))
        return stream.select(
            F.col("user_id").alias("run_id"),
            F.when(F.col("event_type") == "view", "front").otherwise("wrist").alias("camera"),
            F.col("event_id").alias("sequence"),
            "captured_at_ns",
            (F.col("value") < 0.5).alias("empty"),
        )

    @cached_property
    def datasets(self) -> DataFrame:
        nation = self("nation").join(self("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return nation.select(
            X.slug(F.col("n_name")).alias("dataset_id"),
            (F.lit(10) * (1 + F.col("n_nationkey") % 3)).cast("int").alias("fps"),
            F.concat(F.lit("sort-"), F.lower("r_name")).alias("task"),
            F.concat(F.lit("arm-"), F.col("n_regionkey")).alias("robot_type"),
            F.when(F.col("n_nationkey") % 2 == 0, "radians").otherwise("degrees").alias("units"),
            F.array(*[F.lit(j) for j in JOINTS]).alias("joint_names"),
            F.array(F.lit("front"), F.lit("wrist")).alias("cameras"),
            F.col("n_nationkey").alias("n_nationkey"),
        )

    @staged_view
    def orders(self) -> DataFrame:
        """Every order with its dataset, its number of line items and its place among the dataset's episodes."""
        counts = self("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("rows"))
        datasets = F.broadcast(self.datasets)
        # Rows are shuffled with the dataset's name only; what else is known of it (a row per nation) joins at the end.
        keyed = (
            self("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
            .join(self("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(datasets.select("dataset_id", "n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", "o_orderdate", "o_orderstatus", "dataset_id", "n_nationkey")
            .join(counts, "o_orderkey", "left")
            .withColumn("rows", F.coalesce("rows", F.lit(0)))
        )
        counted = (~is_open(F.col("o_orderkey")) | (F.col("n_nationkey") % 5 == 0)).cast("long")
        block = F.floor(F.col("o_orderkey") / 65536).cast("long")
        placed = running_total(keyed, ["dataset_id"], ["o_orderkey"], block, counted, "_place")
        return (
            placed.withColumn("episode_index", F.col("_place") - 1).drop("_place")
            .withColumn("open", is_open(F.col("o_orderkey")))
            .join(datasets.drop("dataset_id"), "n_nationkey")
        )

    @cached_property
    def episodes(self) -> DataFrame:
        """Saved episodes as the manifests declare them."""
        key = F.col("o_orderkey")
        cams = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("front"), F.lit("wrist"))).otherwise(
            F.when(F.col("o_orderstatus") == "O", F.array(F.lit("front"))).otherwise(
                F.array().cast("array<string>")
            )
        )
        declared = F.col("rows") + (key % 97 == 0).cast("long")
        return self.orders.where(~F.col("open")).select(
            "dataset_id",
            "episode_index",
            F.when(key % 13 != 0, F.concat(F.lit("ep-"), key)).alias("episode_id"),
            F.concat(F.lit("run-"), key).alias("run_id"),
            F.when(key % 17 == 0, "").otherwise(F.col("task")).alias("task"),
            "fps",
            declared.alias("frames"),
            F.when(key % 11 != 0, declared / F.col("fps")).alias("duration_seconds"),
            F.when(key % 89 == 0, F.reverse("joint_names")).otherwise(F.col("joint_names")).alias("joint_names"),
            F.when(key % 19 != 0, F.col("units")).alias("units"),
            cams.alias("cameras"),
            F.col("o_orderdate").cast("timestamp").alias("started_at"),
            F.when(key % 7 != 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias(
                "completed_at"
            ),
            (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 2 HOUR")).alias("saved_at"),
        )

    @cached_property
    def journals(self) -> DataFrame:
        """Every recording that was ever opened, with the frames its journal holds."""
        return self.orders.select(
            "dataset_id",
            F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"),
            "episode_index",
            F.col("rows").alias("frames"),
            "fps",
            F.col("o_orderdate").cast("timestamp").alias("started_at"),
        )

    @staged_view
    def frames_orders(self) -> DataFrame:
        """Frames of the saved manifest episodes, one per line item."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"]
        block = F.floor(F.col("l_linenumber") / 4096).cast("long")
        saved = self.orders.where(~F.col("open")).select("dataset_id", "episode_index", "o_orderkey", "rows")
        # The orders know how many lines each has, so no count of the lines is needed.
        short = (saved.agg(F.max("rows")).first()[0] or 0) <= block_rows(self.spark)
        lines = self("lineitem").where(~is_open(F.col("l_orderkey"))).select("l_orderkey", *order)
        # Numbering and the join share one shuffle of the lines by their key; columns of the dataset join after that.
        indexed = dense_index(lines, ["l_orderkey"], order, block, "frame_index", short)
        held = indexed.join(saved.drop("rows"), F.col("l_orderkey") == F.col("o_orderkey"))
        joined = held.join(F.broadcast(self.datasets.select("dataset_id", "fps", "task")), "dataset_id")
        state = [
            (F.col("l_quantity") / 50).cast("float"),
            F.col("l_discount").cast("float"),
            F.when(F.col("l_linestatus") == "O", OPEN).otherwise(SHUT).cast("float"),
        ]
        command = [
            (F.col("l_quantity") / 49).cast("float"),
            F.col("l_discount").cast("float"),
            F.when(F.col("l_returnflag") == "N", OPEN).otherwise(SHUT).cast("float"),
        ]
        slow = F.when(F.col("o_orderkey") % 83 == 0, F.lit(0)).otherwise(F.col("frame_index"))
        return joined.select(
            "dataset_id",
            "episode_index",
            "frame_index",
            (slow / F.col("fps")).cast("float").alias("timestamp"),
            F.when(F.col("frame_index") == 0, " ").otherwise(F.col("task")).alias("task"),
            F.array(*[F.lit(j) for j in JOINTS]).alias("joint_names"),
            F.array(*state).alias("observation_state"),
            F.array(*command).alias("action"),
            F.when(F.col("o_orderkey") % 79 == 0, F.array(*command[:2])).otherwise(F.array(*command)).alias(
                "leader_state"
            ),
            F.col("l_partkey").alias("sample_sequence"),
            (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("captured_at_ns"),
        )


# --- the same views as SQL ----------------------------------------------------------------------------------------

cte(
    "ev",
    """
SELECT event_id, user_id, event_type, value, ts, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
       epoch_us(ts) * 1000 AS captured_at_ns
FROM events""",
)
cte(
    "fe",
    """
SELECT 'events-demo' AS dataset_id, user_id AS episode_index, 'ep-' || user_id AS episode_id,
       row_number() OVER w - 1 AS frame_index, count(*) OVER (PARTITION BY user_id) AS n,
       event_id AS sample_sequence, captured_at_ns, captured_at_ns + k * 1000000 AS recorded_at_ns,
       'task-' || (user_id % 3) AS task,
       CAST(CAST((row_number() OVER w - 1) / 30.0 AS FLOAT) AS DOUBLE) AS timestamp,
       o0, o1, o2, coalesce(lead(o0) OVER w, o0) AS a0, coalesce(lead(o1) OVER w, o1) AS a1, a2
FROM (SELECT *, CAST(CAST(value / 100 AS FLOAT) AS DOUBLE) AS o0, CAST(CAST(k / 100.0 AS FLOAT) AS DOUBLE) AS o1,
             CAST(CAST(CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 0.9 ELSE 0.05 END AS FLOAT)
                  AS DOUBLE) AS o2,
             CAST(CAST(CASE WHEN event_type IN ('click', 'view') THEN 0.05 WHEN value < 60 THEN 0.9 ELSE 0.05 END
                  AS FLOAT) AS DOUBLE) AS a2
      FROM ev)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "ev",
)
cte(
    "fel",
    """
SELECT episode_index, frame_index, n, c.channel, c.joint, c.v
FROM fe, LATERAL (VALUES ('observation', 0, o0), ('observation', 1, o1), ('observation', 2, o2),
                         ('action', 0, a0), ('action', 1, a1), ('action', 2, a2),
                         ('leader', 0, a0), ('leader', 1, a1), ('leader', 2, a2)) AS c(channel, joint, v)""",
    "fe",
)
cte(
    "fln",
    """
SELECT 'lines-demo' AS dataset_id, l_suppkey AS episode_index, row_number() OVER w - 1 AS frame_index,
       count(*) OVER (PARTITION BY l_suppkey) AS n, o0, o1, o2, o3,
       coalesce(lead(o0) OVER w, o0) AS a0, coalesce(lead(o1) OVER w, o1) AS a1, coalesce(lead(o2) OVER w, o2) AS a2, a3
FROM (SELECT *, CAST(CAST(l_quantity / 50 AS FLOAT) AS DOUBLE) AS o0, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS o1,
             CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS o2,
             CAST(CAST(CASE WHEN l_linestatus = 'O' THEN 0.9 ELSE 0.05 END AS FLOAT) AS DOUBLE) AS o3,
             CAST(CAST(CASE WHEN l_returnflag = 'N' THEN 0.9 ELSE 0.05 END AS FLOAT) AS DOUBLE) AS a3
      FROM lineitem)
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
             l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""",
)
cte(
    "fv",
    """
SELECT 'vec-demo' AS dataset_id, CAST(label AS BIGINT) AS episode_index, vec_id,
       row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, embedding
FROM embeddings""",
)
cte(
    "pts",
    """
SELECT dataset_id, episode_index, frame_index,
       CAST(embedding[1] AS DOUBLE) * 100.0::DOUBLE * s AS x, CAST(embedding[2] AS DOUBLE) * 100.0::DOUBLE * s AS y,
       CAST(embedding[3] AS DOUBLE) * 100.0::DOUBLE * s AS z
FROM (SELECT *, CASE WHEN vec_id % 17 = 0 THEN 50.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM fv)""",
    "fv",
)
cte(
    "smp",
    """
SELECT user_id AS run_id, event_id AS sequence, captured_at_ns, event_type <> 'error' AS armed, value >= 1 AS live,
       CAST(CAST(value / 100 AS FLOAT) AS DOUBLE) AS j0, CAST(CAST(k / 100.0 AS FLOAT) AS DOUBLE) AS j1,
       CAST(CAST(0.9 AS FLOAT) AS DOUBLE) AS j2
FROM ev WHERE event_type NOT IN ('view', 'click')""",
    "ev",
)
cte(
    "cam",
    """
SELECT user_id AS run_id, CASE WHEN event_type = 'view' THEN 'front' ELSE 'wrist' END AS camera,
       event_id AS sequence, captured_at_ns, value < 0.5 AS empty
FROM ev WHERE event_type IN ('view', 'click')""",
    "ev",
)
cte(
    "ds",
    """
SELECT n_name AS dataset_id, 10 * (1 + n_nationkey % 3) AS fps, 'sort-' || lower(r_name) AS task,
       'arm-' || n_regionkey AS robot_type, CASE WHEN n_nationkey % 2 = 0 THEN 'radians' ELSE 'degrees' END AS units,
       'shoulder,elbow,gripper' AS joint_names, n_nationkey
FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "ord",
    """
SELECT ds.dataset_id, ds.fps, ds.task, ds.robot_type, ds.units, ds.joint_names, ds.n_nationkey, o.o_orderkey,
       o.o_orderdate, o.o_orderstatus, coalesce(c.rows, 0) AS rows, o.o_orderkey % 50 = 0 AS open,
       CAST(sum(CASE WHEN o.o_orderkey % 50 <> 0 OR ds.n_nationkey % 5 = 0 THEN 1 ELSE 0 END)
            OVER (PARTITION BY ds.dataset_id ORDER BY o.o_orderkey ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT)
         AS episode_index
FROM orders o JOIN customer ON o_custkey = c_custkey JOIN ds ON c_nationkey = ds.n_nationkey
LEFT JOIN (SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1) c ON c.l_orderkey = o.o_orderkey""",
    "ds",
)
cte(
    "eps",
    """
SELECT dataset_id, episode_index, o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN 'ep-' || o_orderkey END AS episode_id,
       'run-' || o_orderkey AS run_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE task END AS task, fps, rows,
       rows + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS frames,
       CASE WHEN o_orderkey % 11 <> 0 THEN (rows + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END)::DOUBLE / fps END
         AS duration_seconds,
       CASE WHEN o_orderkey % 89 = 0 THEN 'gripper,elbow,shoulder' ELSE joint_names END AS joint_names,
       CASE WHEN o_orderkey % 19 <> 0 THEN units END AS units,
       CASE o_orderstatus WHEN 'F' THEN ['front', 'wrist'] WHEN 'O' THEN ['front'] ELSE [] END AS cameras,
       o_orderdate AS started_at,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at,
       o_orderdate + INTERVAL 2 HOUR AS saved_at
FROM ord WHERE NOT open""",
    "ord",
)
cte(
    "jrn",
    """
SELECT dataset_id, 'run-' || o_orderkey AS run_id, episode_index, rows AS frames, fps, o_orderdate AS started_at
FROM ord""",
    "ord",
)
cte(
    "fo",
    """
SELECT d.dataset_id, d.episode_index, d.o_orderkey, d.fps, frame_index,
       CAST(CAST(CASE WHEN d.o_orderkey % 83 = 0 THEN 0 ELSE frame_index END / d.fps AS FLOAT) AS DOUBLE) AS timestamp,
       CASE WHEN frame_index = 0 THEN ' ' ELSE d.task END AS task,
       CAST(CAST(l_quantity / 50 AS FLOAT) AS DOUBLE) AS o0, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS o1,
       CAST(CAST(CASE WHEN l_linestatus = 'O' THEN 0.9 ELSE 0.05 END AS FLOAT) AS DOUBLE) AS o2,
       CAST(CAST(l_quantity / 49 AS FLOAT) AS DOUBLE) AS a0, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS a1,
       CAST(CAST(CASE WHEN l_returnflag = 'N' THEN 0.9 ELSE 0.05 END AS FLOAT) AS DOUBLE) AS a2,
       CASE WHEN d.o_orderkey % 79 = 0 THEN 2 ELSE 3 END AS leader_width,
       l_partkey AS sample_sequence, epoch_us(l_shipdate) * 1000 AS captured_at_ns
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
             l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS frame_index
      FROM lineitem) l
JOIN ord d ON d.o_orderkey = l.l_orderkey WHERE NOT d.open""",
    "ord",
)
