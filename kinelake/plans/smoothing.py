"""Filters, jerk and path operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import aggregates as A
from kinelake.operators import filters as S
from kinelake.operators import paths as G
from kinelake.operators import projections as P
from kinelake.plans.basics import r6
from kinelake.plans.ordered import JERK_SQL
from kinelake.plans.registry import cte, query
from kinelake.schema import CHANNEL_COLUMN, CHANNELS

ACTION = ("action",)


def fir_cte(name: str, weights: list[float]) -> None:
    reach = len(weights) // 2
    rows = ", ".join(f"({k - reach}, {w!r}::DOUBLE)" for k, w in enumerate(weights))
    cte(name, f"SELECT * FROM {name}_all WHERE channel = 'action'", f"{name}_all")
    cte(
        f"{name}_all",
        f"""
SELECT a.episode_index, a.frame_index, a.channel, a.joint, a.n,
       CASE WHEN a.frame_index = 0 OR a.frame_index = a.n - 1 THEN any_value(a.v) ELSE sum(k.w * b.v) END AS v
FROM fel a CROSS JOIN (VALUES {rows}) AS k(k, w)
JOIN fel b ON b.episode_index = a.episode_index AND b.channel = a.channel AND b.joint = a.joint
          AND b.frame_index = least(greatest(a.frame_index + k.k, 0), a.n - 1)
GROUP BY a.episode_index, a.frame_index, a.channel, a.joint, a.n""",
        "fel",
    )


fir_cte("fma", S.moving_average_weights(1.0))
fir_cte("fga", S.gaussian_weights(1.0))

_WINDOW = S.savgol_window(1.0)
_FIT = S.polynomial_projection(_WINDOW)
_ROWS = ", ".join(
    f"({i}, {k}, {float(_FIT[i][k])!r}::DOUBLE)" for i in range(_WINDOW) for k in range(_WINDOW)
)
cte(
    "fsg_all",
    f"""
SELECT a.episode_index, a.frame_index, a.channel, a.joint, a.n,
       CASE WHEN a.frame_index = 0 OR a.frame_index = a.n - 1 THEN any_value(a.v) ELSE sum(m.w * b.v) END AS v
FROM (SELECT *, least(greatest(frame_index - {_WINDOW // 2}, 0), n - {_WINDOW}) AS start FROM fel) a
JOIN (VALUES {_ROWS}) AS m(i, k, w) ON m.i = a.frame_index - a.start
JOIN fel b ON b.episode_index = a.episode_index AND b.channel = a.channel AND b.joint = a.joint AND b.frame_index = a.start + m.k
GROUP BY a.episode_index, a.frame_index, a.channel, a.joint, a.n""",
    "fel",
)

FILTERED = "SELECT episode_index, frame_index, channel, joint, round(v, 6) AS value FROM "


@query("F1_moving_average", "fma_all", sql=FILTERED + "fma_all")
def f1(t):
    return long_channels(t, S.moving_average(t.frames_events, 1.0, CHANNELS))


@query("F2_gaussian", "fga_all", sql=FILTERED + "fga_all")
def f2(t):
    return long_channels(t, S.gaussian(t.frames_events, 1.0, CHANNELS))


@query("F3_savgol", "fsg_all", sql=FILTERED + "fsg_all")
def f3(t):
    return long_channels(t, S.savgol(t.frames_events, 1.0, CHANNELS))


def long_channels(t, smoothed):
    """All smoothed channels, one row per joint."""
    channels = [F.struct(F.lit(c).alias("channel"), F.col(CHANNEL_COLUMN[c]).alias("x")) for c in CHANNELS]
    rows = smoothed.select("episode_index", "frame_index", F.explode(F.array(*channels)).alias("c"))
    return rows.select("episode_index", "frame_index", F.col("c.channel").alias("channel"), F.posexplode("c.x").alias("joint", "v")).select(
        "episode_index", "frame_index", "channel", "joint", r6(F.col("v")).alias("value")
    )


# Forward and backward substitution with the banded factors of R + Q'Q at unit knots and penalty 1: diagonal 2/3 + 6, then 1/6 - 4, then 1.
SPLINE_SQL = """
RECURSIVE WITH k AS (SELECT 2.0::DOUBLE / 3 + 6 AS diag, 1.0::DOUBLE / 6 - 4 AS one, 1.0::DOUBLE AS two),
top AS (SELECT max(n) - 3 AS last FROM fel),
fac(i, d, before, l1, l2) AS (
  SELECT 0::BIGINT, diag, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM k
  UNION ALL
  SELECT i + 1, diag - n1 * n1 * d - CASE WHEN i >= 1 THEN n2 * n2 * before ELSE 0 END, d, n1, n2
  FROM (SELECT *, (one - CASE WHEN i >= 1 THEN n2 * l1 * before ELSE 0 END) / d AS n1
        FROM (SELECT fac.*, k.*, CASE WHEN i >= 1 THEN two / before ELSE 0 END AS n2 FROM fac, k)), top WHERE i < last),
bend AS (
  SELECT a.episode_index, a.channel, a.joint, a.frame_index AS i, a.n - 2 AS m, a.v - 2 * b.v + c.v AS g
  FROM fel a JOIN fel b ON b.episode_index = a.episode_index AND b.channel = a.channel AND b.joint = a.joint AND b.frame_index = a.frame_index + 1
  JOIN fel c ON c.episode_index = a.episode_index AND c.channel = a.channel AND c.joint = a.joint AND c.frame_index = a.frame_index + 2
  WHERE a.n >= 5),
fwd(episode_index, channel, joint, i, m, c, before) AS (
  SELECT episode_index, channel, joint, i, m, g, 0.0::DOUBLE FROM bend WHERE i = 0
  UNION ALL
  SELECT b.episode_index, b.channel, b.joint, b.i, b.m, b.g - f.l1 * p.c - f.l2 * p.before, p.c
  FROM fwd p JOIN bend b ON b.episode_index = p.episode_index AND b.channel = p.channel AND b.joint = p.joint AND b.i = p.i + 1 JOIN fac f ON f.i = b.i),
scaled AS (SELECT w.*, w.c / f.d AS z, coalesce(f1.l1, 0) AS u1, coalesce(f2.l2, 0) AS u2
  FROM fwd w JOIN fac f ON f.i = w.i LEFT JOIN fac f1 ON f1.i = w.i + 1 LEFT JOIN fac f2 ON f2.i = w.i + 2),
back(episode_index, channel, joint, i, c, after) AS (
  SELECT episode_index, channel, joint, i, z, 0.0::DOUBLE FROM scaled WHERE i = m - 1
  UNION ALL
  SELECT s.episode_index, s.channel, s.joint, s.i, s.z - s.u1 * p.c - s.u2 * p.after, p.c
  FROM back p JOIN scaled s ON s.episode_index = p.episode_index AND s.channel = p.channel AND s.joint = p.joint AND s.i = p.i - 1)
SELECT a.episode_index, a.frame_index, a.channel, a.joint,
       round(CASE WHEN a.frame_index = 0 OR a.frame_index = a.n - 1 THEN a.v
                  ELSE a.v - coalesce(c0.c, 0) + 2 * coalesce(c1.c, 0) - coalesce(c2.c, 0) END, 6) AS value
FROM fel a
LEFT JOIN back c0 ON c0.episode_index = a.episode_index AND c0.channel = a.channel AND c0.joint = a.joint AND c0.i = a.frame_index
LEFT JOIN back c1 ON c1.episode_index = a.episode_index AND c1.channel = a.channel AND c1.joint = a.joint AND c1.i = a.frame_index - 1
LEFT JOIN back c2 ON c2.episode_index = a.episode_index AND c2.channel = a.channel AND c2.joint = a.joint AND c2.i = a.frame_index - 2"""


@query("F4_spline", "fel", sql=SPLINE_SQL)
def f4(t):
    return long_channels(t, S.spline(t.frames_events, 1.0, CHANNELS))


@query("F4_spline_cross_validated")
def f4_cross_validated(t):
    """Not SQL: the penalty is a minimum over fits; tests compare it with a search over whole series."""
    return long_channels(t, S.spline(t.frames_events, 0.0, CHANNELS))


@query(
    "F5_one_euro",
    "fel",
    sql="""
RECURSIVE WITH s AS (SELECT episode_index, frame_index, channel, joint, n, v FROM fel),
e(episode_index, channel, joint, frame_index, x, dx) AS (
  SELECT episode_index, channel, joint, frame_index, v, 0.0::DOUBLE FROM s WHERE frame_index = 0
  UNION ALL
  SELECT episode_index, channel, joint, frame_index, a * v + (1 - a) * x, dxh
  FROM (SELECT *, 1.0 / (1.0 + (1.0 / (2 * pi() * (1.0 + 0.007 * abs(dxh)))) * 30) AS a
        FROM (SELECT s.episode_index, s.channel, s.joint, s.frame_index, s.v, e.x,
                     (1.0 / (1.0 + (1.0 / (2 * pi())) * 30)) * ((s.v - e.x) * 30) + (1 - 1.0 / (1.0 + (1.0 / (2 * pi())) * 30)) * e.dx AS dxh
              FROM e JOIN s ON s.episode_index = e.episode_index AND s.channel = e.channel AND s.joint = e.joint AND s.frame_index = e.frame_index + 1)))
SELECT s.episode_index, s.frame_index, s.channel, s.joint, round(CASE WHEN s.frame_index = s.n - 1 THEN s.v ELSE e.x END, 6) AS value
FROM e JOIN s ON s.episode_index = e.episode_index AND s.channel = e.channel AND s.joint = e.joint AND s.frame_index = e.frame_index""",
)
def f5(t):
    return long_channels(t, S.one_euro_filter(t.frames_events, 1.0, 30.0, CHANNELS))


@query("F6_passthrough", "fel", sql=FILTERED + "fel")
def f6(t):
    return long_channels(t, S.smooth(t.frames_events, "none", 1.0, channels=CHANNELS))


@query(
    "F7_method_labels",
    "eps",
    sql="""
SELECT dataset_id, episode_index, CASE episode_index % 3 WHEN 0 THEN 'gaussian' WHEN 1 THEN 'savgol' ELSE 'median' END AS requested_method,
       CASE WHEN frames < 3 THEN 'none' WHEN episode_index % 3 = 1 THEN 'savgol' ELSE 'gaussian' END AS effective_method
FROM eps""",
)
def f7(t):
    out = None
    for i, name in enumerate(("gaussian", "savgol", "median")):
        part = S.method_labels(t.episodes.where(F.col("episode_index") % 3 == i), name)
        out = part if out is None else out.unionByName(part)
    return out.select("dataset_id", "episode_index", "requested_method", "effective_method")


@query(
    "F8_smooth",
    "fel", "fga",
    sql=f"""
WITH a AS ({JERK_SQL.format(src="(SELECT * FROM fel WHERE channel = 'action')")}), b AS ({JERK_SQL.format(src='fga')})
SELECT a.episode_index, 'gaussian' AS method, 1.0::DOUBLE AS strength, round(a.jerk, 6) AS jerk_raw, round(b.jerk, 6) AS jerk_smoothed,
       round(CASE WHEN a.jerk > 1e-12 THEN greatest(0, (1 - b.jerk / a.jerk) * 100) ELSE 0 END, 6) AS jerk_reduction_pct
FROM a JOIN b ON b.episode_index = a.episode_index""",
)
def f8(t):
    frames = t.frames_events
    smoothed = S.smooth(frames, "gaussian", 1.0)
    kinds = smoothed.groupBy("episode_index").agg(
        F.first("smoothing_method").alias("method"), F.first("smoothing_strength").alias("strength")
    )
    return A.jerk_reduction(frames, smoothed, "action").join(kinds, "episode_index").select(
        "episode_index", "method", "strength",
        *[r6(F.col(c)).alias(c) for c in ("jerk_raw", "jerk_smoothed", "jerk_reduction_pct")],
    )


@query(
    "A12_jerk_reduction",
    "fel", "fma",
    sql=f"""
WITH a AS ({JERK_SQL.format(src="(SELECT * FROM fel WHERE channel = 'action')")}), b AS ({JERK_SQL.format(src='fma')})
SELECT a.episode_index, round(CASE WHEN a.jerk > 1e-12 THEN greatest(0, (1 - b.jerk / a.jerk) * 100) ELSE 0 END, 6) AS jerk_reduction_pct
FROM a JOIN b ON b.episode_index = a.episode_index""",
)
def a12(t):
    smoothed = S.moving_average(t.frames_events, 1.0, ACTION)
    return A.jerk_reduction(t.frames_events, smoothed, "action").select(
        "episode_index", r6(F.col("jerk_reduction_pct")).alias("jerk_reduction_pct")
    )


@query(
    "L5_preview",
    "fel", "fga",
    sql="""
SELECT r.episode_index, r.frame_index, round(r.v, 6) AS raw, round(s.v, 6) AS smoothed
FROM fel r JOIN fga s ON s.episode_index = r.episode_index AND s.frame_index = r.frame_index AND s.joint = r.joint
WHERE r.channel = 'action' AND r.joint = 0""",
)
def l5(t):
    smoothed = S.gaussian(t.frames_events, 1.0, ACTION)
    return P.preview(t.frames_events, smoothed, "no-such-channel", 7).select(
        "episode_index", "frame_index", r6(F.col("raw")).alias("raw"), r6(F.col("smoothed")).alias("smoothed")
    )


# --- paths --------------------------------------------------------------------------------------------------------

# Quantised so that consecutive duplicates occur.
cte(
    "ptq",
    """
SELECT dataset_id, episode_index, frame_index, floor(x / 8) * 8.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM pts""",
    "pts",
)


def rough_points(t):
    return t.points.select(
        "dataset_id", "episode_index", "frame_index", (F.floor(F.col("x") / 8) * F.lit(8.0)).alias("x"),
        F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
    )


@query(
    "W10_dedupe_consecutive",
    "ptq",
    sql="""
SELECT episode_index, frame_index, x FROM (SELECT *, lag(x) OVER (PARTITION BY episode_index ORDER BY frame_index) AS p FROM ptq) WHERE p IS NULL OR p <> x""",
)
def w10(t):
    return G.dedupe_consecutive(rough_points(t)).select("episode_index", "frame_index", "x")


cte(
    "spl",
    """
SELECT s.*, h.threshold, sum(CASE WHEN coalesce(s.step > h.threshold, FALSE) THEN 1 ELSE 0 END)
         OVER (PARTITION BY s.episode_index ORDER BY s.frame_index ROWS UNBOUNDED PRECEDING) AS piece
FROM (SELECT episode_index, frame_index, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS step
      FROM pts WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)) s
JOIN (SELECT m.episode_index, greatest(m.med * 8, m.med + quantile_disc(abs(d.step - m.med), 0.5) * 8, 1e-4) AS threshold
      FROM (SELECT episode_index, quantile_disc(step, 0.5) AS med FROM stp GROUP BY 1) m
      JOIN stp d ON d.episode_index = m.episode_index GROUP BY m.episode_index, m.med) h ON h.episode_index = s.episode_index""",
    "pts", "stp",
)
cte(
    "stp",
    """
SELECT * FROM (SELECT episode_index, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS step
FROM pts WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)) WHERE step > 1e-9""",
    "pts",
)


@query(
    "W8_split_path",
    "spl",
    sql="""
SELECT episode_index, frame_index, CAST(piece AS BIGINT) AS piece, round(threshold, 6) AS threshold, piece_points
FROM (SELECT *, count(*) OVER (PARTITION BY episode_index, piece) AS piece_points FROM spl) WHERE piece_points >= 2""",
)
def w8(t):
    return G.split_path(t.points).select(
        "episode_index", "frame_index", "piece", r6(F.col("threshold")).alias("threshold"), "piece_points"
    )


@query(
    "W8_path_cuts",
    "spl",
    sql="""
SELECT episode_index, count(*) AS points, count(*) FILTER (step > threshold) AS cuts, round(max(threshold), 6) AS threshold FROM spl GROUP BY 1""",
)
def w8_cuts(t):
    return G.path_cuts(t.points).select("episode_index", "points", "cuts", r6(F.col("threshold")).alias("threshold"))


@query(
    "W9_keep_segments",
    "spl",
    sql="""
SELECT episode_index, frame_index, minimum_points, piece_points >= minimum_points AS kept
FROM (SELECT s.*, t.total, CASE WHEN t.total < 4 THEN 4 ELSE least(t.total, greatest(8, least(30, CAST(ceil(t.total * 0.02) AS BIGINT)))) END AS minimum_points
      FROM (SELECT *, count(*) OVER (PARTITION BY episode_index, piece) AS piece_points FROM spl) s
      JOIN (SELECT episode_index, count(*) AS total FROM pts GROUP BY 1) t ON t.episode_index = s.episode_index) WHERE piece_points >= 2""",
)
def w9(t):
    totals = t.points.groupBy("dataset_id", "episode_index").agg(F.count(F.lit(1)).alias("total"))
    return G.keep_segments(G.split_path(t.points), totals).select("episode_index", "frame_index", "minimum_points", "kept")


# Spikes judged against the last kept point, frame by frame.
SPIKE_SQL = """RECURSIVE WITH s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS step,
                  lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, count(*) OVER (PARTITION BY episode_index) AS n
           FROM pts WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
m AS (SELECT episode_index, quantile_disc(step, 0.5) AS med FROM s WHERE step IS NOT NULL GROUP BY 1),
h AS (SELECT m.episode_index, greatest(m.med * 8, m.med + 8 * quantile_disc(abs(s.step - m.med), 0.5), 1e-4) AS lim
      FROM m JOIN s ON s.episode_index = m.episode_index WHERE s.step IS NOT NULL GROUP BY m.episode_index, m.med),
k(episode_index, frame_index, kx, ky, kz, kept) AS (
  SELECT episode_index, frame_index, x, y, z, TRUE FROM s WHERE frame_index = 0
  UNION ALL
  SELECT episode_index, frame_index, CASE WHEN spike THEN kx ELSE x END, CASE WHEN spike THEN ky ELSE y END, CASE WHEN spike THEN kz ELSE z END, NOT spike
  FROM (SELECT s.*, k.kx, k.ky, k.kz, s.n >= 4 AND s.frame_index < s.n - 1
               AND sqrt(power(x - kx, 2) + power(y - ky, 2) + power(z - kz, 2)) > lim AND sqrt(power(x - nx, 2) + power(y - ny, 2) + power(z - nz, 2)) > lim
               AND sqrt(power(kx - nx, 2) + power(ky - ny, 2) + power(kz - nz, 2)) <= lim * 2 AS spike
        FROM k JOIN s ON s.episode_index = k.episode_index AND s.frame_index = k.frame_index + 1 JOIN h ON h.episode_index = s.episode_index))
"""
CLEAN_SQL = """,
p1 AS (SELECT s.episode_index, s.frame_index, s.x, s.y, s.z FROM k JOIN s ON s.episode_index = k.episode_index AND s.frame_index = k.frame_index WHERE kept),
p2 AS (SELECT * FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM p1 WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
       WHERE px IS NULL OR px <> x OR py <> y OR pz <> z),
p3 AS (SELECT episode_index, frame_index, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS step
       FROM p2 WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
p4 AS (SELECT episode_index, quantile_disc(step, 0.5) AS med FROM p3 WHERE step > 1e-9 GROUP BY 1),
p5 AS (SELECT p4.episode_index, greatest(p4.med * 8, p4.med + 8 * quantile_disc(abs(step - p4.med), 0.5), 1e-4) AS lim
       FROM p4 JOIN p3 ON p3.episode_index = p4.episode_index WHERE step > 1e-9 GROUP BY p4.episode_index, p4.med),
p6 AS (SELECT p3.episode_index, sum(CASE WHEN coalesce(step > lim, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY p3.episode_index ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS piece
       FROM p3 JOIN p5 ON p5.episode_index = p3.episode_index),
p7 AS (SELECT episode_index, piece, count(*) AS c FROM p6 GROUP BY ALL HAVING count(*) >= 2),
p8 AS (SELECT episode_index, count(*) AS total FROM p2 GROUP BY 1),
p9 AS (SELECT p8.episode_index, p8.total, count(p7.c) FILTER (p8.total >= 4 AND p7.c >= least(p8.total, greatest(8, least(30, CAST(ceil(p8.total * 0.02) AS BIGINT))))) AS segments, count(p7.c) AS pieces
       FROM p8 LEFT JOIN p7 ON p7.episode_index = p8.episode_index GROUP BY ALL)
SELECT episode_index, total, segments, pieces - segments AS discarded_fragments,
       CASE WHEN segments > 0 THEN 'built' WHEN pieces > 0 THEN 'discarded' ELSE 'stationary' END AS outcome FROM p9
"""


@query("W13_clean_path", "pts", sql=SPIKE_SQL + CLEAN_SQL)
def w13(t):
    return G.clean_path(t.points).select("episode_index", "total", "segments", "discarded_fragments", "outcome")


@query(
    "F9_sanitize",
    "fe",
    sql="""
WITH v AS (SELECT episode_index, joint, frame_index, CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS x
           FROM fe, LATERAL (VALUES (0, CASE WHEN sample_sequence % 41 = 0 THEN 'nan'::DOUBLE WHEN sample_sequence % 43 = 0 THEN 'inf'::DOUBLE ELSE o0 END),
                                    (1, CASE WHEN episode_index % 13 = 0 THEN NULL WHEN sample_sequence % 37 = 0 THEN o1 + 60.0::DOUBLE ELSE frame_index * 0.01::DOUBLE END)) AS c(joint, x)),
s AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q, abs(x - lag(x) OVER w) AS step FROM v WINDOW w AS (PARTITION BY episode_index, joint ORDER BY frame_index)),
m AS (SELECT episode_index, joint, quantile_disc(x, 0.5) AS c, quantile_disc(step, 0.5) AS ts FROM s GROUP BY ALL),
d AS (SELECT m.episode_index, m.joint, m.c, quantile_disc(abs(x - m.c), 0.5) AS mad,
             coalesce(greatest(m.ts * 8, m.ts + quantile_disc(abs(step - m.ts), 0.5) * 8, 1e-6), 1e-6) AS jump
      FROM m JOIN s ON s.episode_index = m.episode_index AND s.joint = m.joint GROUP BY m.episode_index, m.joint, m.c, m.ts),
f AS (SELECT s.*, d.c, x IS NULL OR coalesce((abs(x - p) > jump AND abs(x - q) > jump AND abs(p - q) <= jump * 2)
             OR (abs(x - c) > greatest(mad * 12, jump * 4, 1e-6) AND abs(p - c) <= greatest(mad * 12, jump * 4, 1e-6) AND abs(q - c) <= greatest(mad * 12, jump * 4, 1e-6)), FALSE) AS bad
      FROM s JOIN d ON d.episode_index = s.episode_index AND d.joint = s.joint),
g AS (SELECT *, last_value(CASE WHEN NOT bad THEN frame_index END IGNORE NULLS) OVER b AS bi, last_value(CASE WHEN NOT bad THEN x END IGNORE NULLS) OVER b AS bv,
             first_value(CASE WHEN NOT bad THEN frame_index END IGNORE NULLS) OVER a AS ai, first_value(CASE WHEN NOT bad THEN x END IGNORE NULLS) OVER a AS av FROM f
      WINDOW b AS (PARTITION BY episode_index, joint ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             a AS (PARTITION BY episode_index, joint ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT episode_index, joint, frame_index, bad AS repaired,
       round(CASE WHEN bad THEN coalesce(bv + (av - bv) * ((frame_index - bi) / (ai - bi)::DOUBLE), bv, av, c, 0) ELSE x END, 6) AS value FROM g""",
)
def f9(t):
    seq, i = F.col("sample_sequence"), F.col("frame_index")
    state = F.col("observation_state")
    first = (
        F.when(seq % 41 == 0, float("nan")).when(seq % 43 == 0, float("inf")).otherwise(F.get(state, F.lit(0)).cast("double"))
    )
    second = (
        F.when(F.col("episode_index") % 13 == 0, F.lit(None).cast("double"))
        .when(seq % 37 == 0, F.get(state, F.lit(1)).cast("double") + 60.0)
        .otherwise(i * F.lit(0.01))
    )
    values = t.frames_events.select(
        "dataset_id", "episode_index", "frame_index", F.lit("observation").alias("channel"),
        F.posexplode(F.array(first, second)).alias("joint", "value"),
    )
    return G.sanitize(values).select(
        "episode_index", "joint", "frame_index", "repaired", r6(F.col("value")).alias("value")
    )


@query("F10_reject_spikes", "pts", sql=SPIKE_SQL + "SELECT episode_index, frame_index FROM k WHERE kept")
def f10(t):
    return G.reject_spikes(t.points).select("episode_index", "frame_index")


@query(
    "U3_filter_arguments",
    "fel",
    sql="""
SELECT a.episode_index, a.frame_index, a.channel, a.joint, round(CASE WHEN a.frame_index = 0 OR a.frame_index = a.n - 1 THEN any_value(a.v) ELSE avg(b.v) END, 6) AS value
FROM fel a CROSS JOIN range(-6, 7) AS k(k)
JOIN fel b ON b.episode_index = a.episode_index AND b.channel = a.channel AND b.joint = a.joint AND b.frame_index = least(greatest(a.frame_index + k.k, 0), a.n - 1)
GROUP BY a.episode_index, a.frame_index, a.channel, a.joint, a.n""",
)
def u3(t):
    return long_channels(t, S.smooth(t.frames_events, "moving_average", 2.0, channels=CHANNELS))
