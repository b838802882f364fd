"""Queries of the CT operators over the derived tables, each with its SQL twin.

Both sides round what isn't whole; whole sums are cast to 64 bits in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raylattice.functions import algebra
from raylattice.operators import acquisition, filtering, lookup, metrics, relational, stencil
from raylattice.plans.derived import ANG_SQL, PROJ_SQL, SYS_SQL, VOL, VOL2, angles, grid, incidence, projections, volume
from raylattice.session import table

QUERIES = {}
ORACLES = {}
CELLS = ["z", "y", "x"]
#: Events of this type are the calibration of the lookups, all others the views that they serve.
BLANK = "purchase"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    return metrics.rounded(df, digits, *(columns or ("value",)))


@query(f"{VOL} SELECT z, y, CAST(sum(value) AS BIGINT) AS value FROM vol GROUP BY z, y")
def q01_parallel_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.project_axis(volume(spark, sf_dir), ["z", "y"])


@query(f"{VOL}, p AS (SELECT z, y, CAST(sum(value) AS BIGINT) AS value FROM vol GROUP BY z, y) SELECT g.z, g.y, g.x, p.value FROM grid g JOIN p USING (z, y)")
def q02_backproject_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.backproject_axis(q01_parallel_project(spark, sf_dir), grid(spark), ["z", "y"])


@query(f"{VOL}, {SYS_SQL} SELECT proj, CAST(ray AS BIGINT) AS ray, CAST(sum(w * value) AS BIGINT) AS value FROM sys JOIN vol USING (z, y, x) GROUP BY proj, ray")
def q03_coo_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.forward(incidence(spark), volume(spark, sf_dir)).select("proj", F.col("ray").cast("bigint").alias("ray"), "value")


FWD = f"{VOL}, {SYS_SQL}, fwd AS (SELECT proj, ray, sum(w * value) AS b FROM sys JOIN vol USING (z, y, x) GROUP BY proj, ray)"


@query(f"{FWD} SELECT z, y, x, CAST(sum(w * b) AS BIGINT) AS value FROM sys JOIN fwd USING (proj, ray) GROUP BY z, y, x")
def q04_coo_adjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = incidence(spark)
    return relational.adjoint(s, relational.forward(s, volume(spark, sf_dir)))


STEP = f"""{VOL2}, {SYS_SQL}, b AS (SELECT proj, ray, CAST(sum(w * value) AS DOUBLE) AS b FROM sys JOIN vol USING (z, y, x) GROUP BY proj, ray),
ax AS (SELECT proj, ray, CAST(sum(w * value) AS DOUBLE) AS a, CAST(sum(w) AS DOUBLE) AS rw FROM sys JOIN vol2 USING (z, y, x) GROUP BY proj, ray),
cw AS (SELECT z, y, x, CAST(sum(w) AS DOUBLE) AS cw FROM sys GROUP BY z, y, x)"""


@query(f"""{STEP}, r AS (SELECT proj, ray, (b - a) / rw AS r FROM b JOIN ax USING (proj, ray)),
u AS (SELECT z, y, x, sum(w * r) AS u FROM sys JOIN r USING (proj, ray) GROUP BY z, y, x)
SELECT z, y, x, round(greatest(0, value + u / cw), 3) AS value FROM vol2 JOIN u USING (z, y, x) JOIN cw USING (z, y, x)""")
def q05_sirt_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = incidence(spark)
    return rounded(relational.sirt_step(s, volume(spark, sf_dir, "A"), relational.forward(s, volume(spark, sf_dir))), 3)


@query(f"""{STEP}, r AS (SELECT proj, ray, CASE WHEN a = 0 THEN 0 ELSE b / a END AS r FROM b JOIN ax USING (proj, ray)),
u AS (SELECT z, y, x, sum(w * r) AS u FROM sys JOIN r USING (proj, ray) GROUP BY z, y, x)
SELECT z, y, x, round(value * (u / cw), 3) AS value FROM vol2 JOIN u USING (z, y, x) JOIN cw USING (z, y, x)""")
def q06_mlem_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = incidence(spark)
    return rounded(relational.mlem_step(s, volume(spark, sf_dir, "A"), relational.forward(s, volume(spark, sf_dir))), 3)


@query(f"""{FWD}, r0 AS (SELECT proj, ray, CAST(b AS DOUBLE) AS r FROM fwd),
p0 AS (SELECT z, y, x, sum(w * r) AS p FROM sys JOIN r0 USING (proj, ray) GROUP BY z, y, x), g0 AS (SELECT sum(p * p) AS g FROM p0),
q0 AS (SELECT proj, ray, sum(w * p) AS q FROM sys JOIN p0 USING (z, y, x) GROUP BY proj, ray), a0 AS (SELECT (SELECT g FROM g0) / sum(q * q) AS a FROM q0),
r1 AS (SELECT proj, ray, r - (SELECT a FROM a0) * q AS r FROM r0 JOIN q0 USING (proj, ray)),
s1 AS (SELECT z, y, x, sum(w * r) AS s FROM sys JOIN r1 USING (proj, ray) GROUP BY z, y, x), g1 AS (SELECT sum(s * s) AS g FROM s1),
p1 AS (SELECT z, y, x, s + (SELECT g FROM g1) / (SELECT g FROM g0) * p AS p FROM s1 JOIN p0 USING (z, y, x)),
q1 AS (SELECT proj, ray, sum(w * p) AS q FROM sys JOIN p1 USING (z, y, x) GROUP BY proj, ray), a1 AS (SELECT (SELECT g FROM g1) / sum(q * q) AS a FROM q1)
SELECT z, y, x, round((SELECT a FROM a0) * p0.p + (SELECT a FROM a1) * p1.p, 3) AS value FROM p0 JOIN p1 USING (z, y, x)""")
def q07_cgls_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = incidence(spark)
    return rounded(relational.cgls(s, relational.forward(s, volume(spark, sf_dir)), 2), 3)


PAIR = f"{VOL2}, pr AS (SELECT CAST(vol.value AS DOUBLE) AS p, CAST(vol2.value AS DOUBLE) AS r FROM vol JOIN vol2 USING (z, y, x))"


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality(volume(spark, sf_dir), volume(spark, sf_dir, "A"), CELLS)


@query(f"{PAIR} SELECT round(sqrt(sum((p - r) * (p - r)) / count(*)), 3) AS rmse, round(sum((p - r) * (p - r)) / 1e12, 3) AS ssd FROM pr")
def q08_rmse_ssd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, sf_dir).select(F.round("rmse", 3).alias("rmse"), F.round(F.col("ssd") / 1e12, 3).alias("ssd"))


@query(f"{PAIR} SELECT round(sqrt(sum((p - r) * (p - r)) / count(*)) / (1e-5 + sqrt(sum(r * r)) / count(*)), 9) AS nrmse FROM pr")
def q09_nrmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, sf_dir).select(F.round("nrmse", 9).alias("nrmse"))


@query(f"{PAIR} SELECT round(corr(p, r), 9) AS cc FROM pr")
def q10_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, sf_dir).select(F.round("cc", 9).alias("cc"))


@query(f"{PAIR} SELECT round(2 * covar_samp(p, r) / (var_pop(r) + var_pop(p)) * (2 * avg(r) * avg(p) / (avg(r) * avg(r) + avg(p) * avg(p))), 9) AS uqi FROM pr")
def q11_uqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, sf_dir).select(F.round("uqi", 9).alias("uqi"))


@query(f"""{PAIR}, s AS (SELECT count(*) AS n, avg(p) AS mp, avg(r) AS mr, var_pop(p) AS vp, var_pop(r) AS vr, covar_samp(p, r) AS c, (max(p) - min(p)) * (max(p) - min(p)) AS d FROM pr)
SELECT round((2 * mp * mr + 0.01 * d) / (mp * mp + mr * mr + 0.01 * d) * (2 * sqrt(vp) * sqrt(vr) + 0.02 * d) / (vp + vr + 0.02 * d) * (c + 0.01 * d) / (sqrt(vp) * sqrt(vr) + 0.01 * d) / n, 12) AS mssim FROM s""")
def q12_mssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, sf_dir).select(F.round("mssim", 12).alias("mssim"))


@query(f"{VOL} SELECT round(sqrt(sum(CAST(value AS DOUBLE) * value)), 3) AS norm FROM vol")
def q13_l2norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.norm(volume(spark, sf_dir)).select(F.round("norm", 3).alias("norm"))


def lines(a: str) -> str:
    return f"(PARTITION BY {', '.join(c for c in CELLS if c != a)} ORDER BY {a})"


def backward_sql(of: str = "vol", value: str = "value") -> str:
    return "SELECT *, " + ", ".join(f"coalesce(CAST({value} AS DOUBLE) - lag({value}) OVER {lines(a)}, 0) AS d{a}" for a in CELLS) + f" FROM {of}"


def gradient_sql(of: str, value: str, name: str, eps: str, delta: float | None = None) -> str:
    weigh = f"SELECT * REPLACE ({', '.join(f'd{a} * exp(-power(d{a} / {delta}, 2)) AS d{a}' for a in CELLS)}) FROM ({backward_sql(of, value)})" if delta else backward_sql(of, value)
    after = " - ".join(f"coalesce(lead(d{a} / len) OVER {lines(a)}, 0)" for a in CELLS)
    return f"""{name}_l AS (SELECT *, sqrt(dz * dz + dy * dy + dx * dx + {eps}) AS len FROM ({weigh})),
{name} AS (SELECT z, y, x, (dz + dy + dx) / len - {after} AS g FROM {name}_l)"""


@query(f"{VOL} SELECT round(sum(sqrt(dz * dz + dy * dy + dx * dx)), 0) AS tv FROM ({backward_sql()})")
def q14_tvnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.tv_norm(volume(spark, sf_dir)).select(F.round("tv", 0).alias("tv"))


@query(f"{VOL}, {gradient_sql('vol', 'value', 'tv', '1e-8')} SELECT z, y, x, round(g, 6) AS value FROM tv")
def q15_tv_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.tv_gradient(volume(spark, sf_dir)))


DELTA = 5e8


@query(f"{VOL}, {gradient_sql('vol', 'value', 'tv', '1e-8', DELTA)} SELECT z, y, x, round(g, 6) AS value FROM tv")
def q16_awtv_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.tv_gradient(volume(spark, sf_dir), delta=DELTA))


@query(f"""{VOL}, s AS (SELECT z, y, x, CAST(value AS DOUBLE) / 1000000 AS u FROM vol), g AS (SELECT *, {', '.join(f'coalesce(lead(u) OVER {lines(a)} - u, 0) AS g{a}' for a in CELLS)} FROM s),
p AS (SELECT *, {', '.join(f'0.02 * g{a} / greatest(1, 0.02 * sqrt(gy * gy + gx * gx + gz * gz)) AS p{a}' for a in CELLS)} FROM g),
d AS (SELECT *, u * (1 - 0.1) + 0.1 * (u + (pz - coalesce(lag(pz) OVER {lines('z')}, 0) + py - coalesce(lag(py) OVER {lines('y')}, 0) + px - coalesce(lag(px) OVER {lines('x')}, 0)) / 0.5) AS u2 FROM p)
SELECT z, y, x, round(u2, 6) AS u FROM d""")
def q17_rof_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = volume(spark, sf_dir).select(*CELLS, (F.col("value").cast("double") / 1000000).alias("f"))
    state = f.select("*", F.col("f").alias("u"), *[F.lit(0.0).alias(f"p{a}") for a in CELLS])
    for _ in range(2):
        state = stencil.rof_step(state, 0.5, 0.1, 0.02)
    return rounded(state.select(*CELLS, "u"), 6, "u")


@query(f"""WITH {PROJ_SQL}, k AS (SELECT CAST(i AS INT) AS off, CASE WHEN i = 0 THEN 0.25 WHEN i % 2 <> 0 THEN -1 / power(pi() * i, 2) ELSE 0 END AS h FROM range(-7, 8) t(i))
SELECT proj_idx, v, CAST(u + off AS INT) AS u, round(sum(h * value), 3) AS value FROM proj JOIN k ON u + off BETWEEN 0 AND 7 GROUP BY 1, 2, 3""")
def q18_ramp_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filtering.ramp_spatial(projections(spark, sf_dir), 8), 3)


@query(f"WITH {PROJ_SQL} SELECT proj_idx, v, u, round(value * 1536 / sqrt(1536 * 1536 + power((u - 3.5) * 0.8, 2) + power((v - 3.5) * 0.8, 2)), 3) AS value FROM proj")
def q19_cosine_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = filtering.cosine_weight((F.col("u") - 3.5) * 0.8, (F.col("v") - 3.5) * 0.8, 1536.0)
    return projections(spark, sf_dir).select("proj_idx", "v", "u", F.round(F.col("value") * w, 3).alias("value"))


def s_sql(x: str) -> str:
    return f"(CASE WHEN {x} <= -0.5 THEN 0 WHEN {x} >= 0.5 THEN 1 ELSE 0.5 * (1 + sin(pi() * ({x}))) END)"


FAN = 0.25


@query(f"""WITH {ANG_SQL}, a AS (SELECT idx, u, radians(angle) AS beta, atan((u - 3.5) * 40 / 1536) AS al FROM ang, (SELECT unnest(range(8)) AS u)),
b AS (SELECT *, 2 * {FAN} - 2 * al AS f, 2 * {FAN} + 2 * al AS r FROM a)
SELECT idx, CAST(u AS INT) AS u, round(0.5 * ({s_sql('beta / f - 0.5')} + {s_sql(f'(beta - 2 * {FAN} + 2 * al) / f + 0.5')} - {s_sql('(beta - pi() + 2 * al) / r - 0.5')} - {s_sql(f'(beta - pi() - 2 * {FAN}) / r + 0.5')}), 9) AS weight FROM b""")
def q20_parker(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = angles(spark, sf_dir).select("idx", F.radians("angle").alias("beta"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("u"))
    return views.select("idx", "u", F.round(filtering.parker_weight(F.col("beta"), F.atan((F.col("u") - 3.5) * 40 / 1536), FAN), 9).alias("weight"))


@query(f"""WITH {PROJ_SQL}, t AS (SELECT *, (u - 3.5) * 0.8 + 0.9 AS t FROM proj)
SELECT proj_idx, v, u, round(value * CASE WHEN t < -1.9 THEN 0 WHEN t > 1.9 THEN 2 ELSE sin(pi() / 2 * atan(t / 1000) / atan(1.9 / 1000)) + 1 END, 3) + 0.0 AS value FROM t""")
def q21_wang(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = filtering.offset_weight((F.col("u") - 3.5) * 0.8 + 0.9, 1.9, 1000.0)
    return projections(spark, sf_dir).select("proj_idx", "v", "u", (F.round(F.col("value") * w, 3) + 0.0).alias("value"))


@query(f"""WITH {PROJ_SQL}, m AS (SELECT proj_idx, v, u, list_sort(list(value) OVER (PARTITION BY proj_idx, v ORDER BY u ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) AS l FROM proj)
SELECT proj_idx, v, u, l[(len(l) + 1) // 2] AS value FROM m""")
def q22_median9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.median_along(projections(spark, sf_dir), ["proj_idx", "v"], "u", 4)


@query(f"WITH {ANG_SQL} SELECT idx, round(ln(greatest(1, 50000 / (i0 + 2.220446049250313e-16) + 2.220446049250313e-16)), 9) AS value FROM ang")
def q23_log_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angles(spark, sf_dir).select("idx", F.round(acquisition.log_normalised(F.col("i0"), F.lit(50000.0)), 9).alias("value"))


@query(f"""WITH {ANG_SQL}, b AS (SELECT angle AS lo, avg(i0) AS v FROM ang WHERE kind = '{BLANK}' GROUP BY 1), c AS (SELECT idx, angle + 0.4e0 AS angle FROM ang WHERE kind IS DISTINCT FROM '{BLANK}'),
s AS (SELECT lo, v, lead(lo) OVER w AS hi, lead(v) OVER w AS hv FROM b WINDOW w AS (ORDER BY lo)),
f AS (SELECT min(lo) AS a, arg_min(v, lo) AS fv, max(lo) AS z, arg_max(v, lo) AS lv FROM b),
t AS (SELECT lo, v, hi, hv FROM s WHERE hi IS NOT NULL UNION ALL SELECT z, lv, a + 360, fv FROM f UNION ALL SELECT z - 360, lv, a, fv FROM f)
SELECT idx, round(v * (1 - (angle - lo) / (hi - lo)) + hv * ((angle - lo) / (hi - lo)), 6) AS blank FROM c JOIN t ON angle >= lo AND angle < hi""")
def q24_interp_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = angles(spark, sf_dir)
    blanks = a.where(F.col("kind") == BLANK).select("angle", F.col("i0").alias("value"))
    views = a.where(~F.col("kind").eqNullSafe(BLANK)).select("idx", (F.col("angle") + 0.4).alias("angle"))
    return rounded(lookup.interpolate_circular(views, blanks).select("idx", "blank"), 6, "blank")


def near_sql(extra: str = "") -> str:
    return f"""WITH {ANG_SQL}, t AS (SELECT idx AS t_idx, angle + idx % 4 * 0.25e0 AS t_angle FROM ang WHERE kind IS DISTINCT FROM '{BLANK}'),
s AS (SELECT min(idx) AS s_idx, angle AS s_angle FROM ang WHERE kind = '{BLANK}' GROUP BY 2),
a AS (SELECT DISTINCT t_angle FROM t),
r AS (SELECT t_angle, s_idx, s_angle, abs(t_angle - s_angle) AS delta, row_number() OVER (PARTITION BY t_angle ORDER BY abs(t_angle - s_angle), s_idx) AS k FROM a, s)
SELECT t_idx, t_angle, s_idx, s_angle, delta FROM t JOIN r USING (t_angle) WHERE k = 1 {extra}"""


def near(spark: SparkSession, sf_dir: str, tolerance: float | None) -> DataFrame:
    a = angles(spark, sf_dir)
    sources = a.where(F.col("kind") == BLANK).select("idx", "angle")
    return lookup.nearest(a.where(~F.col("kind").eqNullSafe(BLANK)).select("idx", (F.col("angle") + F.col("idx") % 4 * 0.25).alias("angle")), sources, tolerance)


@query(near_sql())
def q25_nearest_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir, None)


@query(near_sql("AND delta <= 0.3"))
def q26_nearest_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir, 0.3)


@query("""WITH RECURSIVE v AS MATERIALIZED (SELECT user_id AS scan_id, event_id AS idx, CAST(event_id * 37 % 360 AS DOUBLE) / 10 AS angle, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE user_id IS NOT NULL),
walk AS (SELECT scan_id, idx, angle, n, angle AS kept, true AS keep FROM v WHERE n = 1 UNION ALL
  SELECT v.scan_id, v.idx, v.angle, v.n, CASE WHEN abs(v.angle - w.kept) > 5.05e0 THEN v.angle ELSE w.kept END, abs(v.angle - w.kept) > 5.05e0 FROM walk w JOIN v ON v.scan_id = w.scan_id AND v.n = w.n + 1)
SELECT scan_id, idx, angle FROM walk WHERE keep""")
def q27_acdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the views of a scan."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("idx"), ((F.col("event_id") * 37 % 360).cast("double") / 10).alias("angle"))
    return lookup.spaced_views(e, 5.05)


@query(f"WITH {ANG_SQL} SELECT idx, angle, i0 FROM ang WHERE idx % 3 = 0")
def q28_sampling_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition.sampled(angles(spark, sf_dir), "step", 3).select("idx", "angle", "i0")


@query(f"WITH {ANG_SQL}, n AS (SELECT count(*) AS n FROM ang) SELECT idx, angle, i0 FROM ang WHERE idx IN (SELECT CAST(floor(k * n / 360.0) AS BIGINT) FROM range(360) t(k), n)")
def q29_sampling_equidistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = angles(spark, sf_dir)
    return acquisition.sampled(a, "equidistant", 360, a.count()).select("idx", "angle", "i0")


@query(f"WITH {ANG_SQL} SELECT idx, angle, i0 FROM ang WHERE idx < 500")
def q30_sampling_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition.sampled(angles(spark, sf_dir), "continuous", 500).select("idx", "angle", "i0")


@query(f"WITH {ANG_SQL} SELECT idx, CAST(idx // 20 AS INT) AS block_id, CAST(idx % 20 AS INT) AS pos_in_block FROM ang")
def q31_subsets_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition.subsets(angles(spark, sf_dir), 20)


@query(f"WITH {PROJ_SQL} SELECT CAST(proj_idx // 20 AS INT) AS block_id, v, u, round(avg(value), 6) AS value FROM proj GROUP BY 1, 2, 3")
def q32_subset_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projections(spark, sf_dir)
    return p.groupBy(F.floor(F.col("proj_idx") / 20).cast("int").alias("block_id"), "v", "u").agg(F.round(F.avg("value"), 6).alias("value"))


#: Coefficients of a made-up basis material.
BASIS = [1.2, -0.4, 0.03, -0.02, 0.05, 0.004, -0.003, 0.002, -0.001]


@query(f"""WITH {PROJ_SQL}, m AS (SELECT a.proj_idx, a.v, a.u, a.value / 1e6 AS l, b.value / 1e6 AS h FROM proj a JOIN proj b ON b.proj_idx = a.proj_idx + 1 AND a.v = b.v AND a.u = b.u WHERE a.proj_idx % 2 = 0)
SELECT proj_idx, v, u, round(1.2*l - 0.4*h + 0.03*l*l - 0.02*l*h + 0.05*h*h + 0.004*l*l*l - 0.003*h*l*l + 0.002*l*h*h - 0.001*h*h*h, 9) AS value FROM m""")
def q33_dual_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projections(spark, sf_dir)
    low = p.where("proj_idx % 2 = 0").withColumnRenamed("value", "l")
    high = p.where("proj_idx % 2 = 1").select((F.col("proj_idx") - 1).alias("proj_idx"), "v", "u", F.col("value").alias("h"))
    value = acquisition.dual_energy(F.col("l") / 1e6, F.col("h") / 1e6, BASIS)
    return low.join(high, ["proj_idx", "v", "u"]).select("proj_idx", "v", "u", F.round(value, 9).alias("value"))


@query(f"{VOL2} SELECT z, y, x, round(0.21e0 * vol.value + 0.47e0 * vol2.value, 3) AS value FROM vol JOIN vol2 USING (z, y, x)")
def q34_virtual_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = volume(spark, sf_dir).join(volume(spark, sf_dir, "A").withColumnRenamed("value", "other"), CELLS)
    return both.select(*CELLS, F.round(acquisition.virtual_mono(F.col("value"), F.col("other"), 0.21, 0.47), 3).alias("value"))


@query(f"{VOL} SELECT z, y, x, CASE WHEN (y - 5) * (y - 5) + (x - 5) * (x - 5) <= 25 THEN value ELSE 0 END AS value FROM vol")
def q35_fov_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition.cylinder(volume(spark, sf_dir), 5, 5, 5)


#: A made-up phantom: a, b, c, x0, y0, z0, phi, amplitude.
PHANTOM = [(0.69, 0.92, 0.81, 0, 0, 0, 0, 1.0), (0.66, 0.87, 0.78, 0, -0.02, 0, 0, -0.8), (0.11, 0.31, 0.22, 0.22, 0, 0, -18, -0.2), (0.16, 0.41, 0.28, -0.22, 0, 0, 18, -0.2)]


@query(
    "WITH e AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in PHANTOM) + ") t(a, b, c, x0, y0, z0, phi, amp)), g AS (SELECT CAST(i // 256 AS INT) AS z, CAST(i // 16 % 16 AS INT) AS y, CAST(i % 16 AS INT) AS x FROM range(4096) t(i)), "
    "p AS (SELECT z, y, x, amp, a, b, c, (x * 2.0 + 1) / 16 - 1 - x0 AS dx, (y * 2.0 + 1) / 16 - 1 - y0 AS dy, (z * 2.0 + 1) / 16 - 1 - z0 AS dz, cos(radians(phi)) AS co, sin(radians(phi)) AS si FROM g, e) "
    "SELECT z, y, x, round(CAST(sum(CASE WHEN power((dx * co + dy * si) / a, 2) + power((dy * co - dx * si) / b, 2) + power(dz / c, 2) <= 1 THEN amp ELSE 0 END) AS DOUBLE), 9) AS value FROM p GROUP BY z, y, x"
)
def q36_ellipsoid_phantom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquisition.ellipsoids(spark, (16, 16, 16), PHANTOM), 9)


@query(f"WITH {ANG_SQL} SELECT idx, i0, CASE WHEN i0 > 0 AND i0 < 1000 THEN 0 WHEN i0 > 1000 AND i0 < 5000 THEN 1 WHEN i0 > 5000 THEN 2 END AS class FROM ang")
def q37_thickness_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.classes(angles(spark, sf_dir).select("idx", "i0"), [0, 1000, 5000], "i0")


@query(f"""{VOL}, s AS (SELECT z AS side, y AS v, x AS u, value FROM vol WHERE z < 2), c AS (SELECT CAST(i AS INT) AS cor FROM range(-3, 4) t(i)),
k AS (SELECT cor, avg(power(CAST(a.value - b.value AS DOUBLE), 2)) AS cost FROM s a JOIN s b ON a.v = b.v AND a.side = 0 AND b.side = 1 JOIN c ON a.u = 10 - b.u + cor GROUP BY cor)
SELECT cor, cost FROM k ORDER BY cost, cor LIMIT 1""")
def q38_cor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = volume(spark, sf_dir).where("z < 2").select(F.col("z").alias("side"), F.col("y").alias("v"), F.col("x").alias("u"), "value")
    return lookup.rotation_centre(p, list(range(-3, 4)), 11)


@query("""SELECT l_linenumber * 100 + CAST(floor(l_quantity / 5) AS INT) AS pixel, round(sum(l_tax * l_tax * l_extendedprice) / nullif(sum(l_tax * l_tax), 0), 4) AS value FROM lineitem GROUP BY 1""")
def q39_weighted_mean_protons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    tracks = t.select((F.col("l_linenumber") * 100 + F.floor(F.col("l_quantity") / 5).cast("int")).alias("pixel"), F.col("l_tax").alias("share"), F.col("l_extendedprice").alias("wepl"))
    return rounded(acquisition.weighted_pixels(tracks), 4)


@query(f"""WITH {PROJ_SQL}, p AS (SELECT proj_idx, v, u, CAST(value + 2000000 AS DOUBLE) AS value FROM proj), d AS (SELECT v, u, avg(value) / 10 AS dark FROM p WHERE proj_idx % 10 = 0 GROUP BY 1, 2),
f AS (SELECT v, u, avg(value) * 2 AS flat FROM p WHERE proj_idx % 10 = 1 GROUP BY 1, 2),
t AS (SELECT proj_idx, v, u, CASE WHEN (value - dark) / (flat - dark) > 0 THEN (value - dark) / (flat - dark) ELSE 0.001 END AS t FROM p JOIN f USING (v, u) JOIN d USING (v, u))
SELECT proj_idx, v, u, round(-ln(t / (SELECT max(t) FROM t)), 9) + 0.0 AS value FROM t""")
def q40_flat_dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projections(spark, sf_dir).withColumn("value", (F.col("value") + 2000000).cast("double"))
    darks = p.where("proj_idx % 10 = 0").select("v", "u", (F.col("value") / 10).alias("value"))
    flats = p.where("proj_idx % 10 = 1").select("v", "u", (F.col("value") * 2).alias("value"))
    return rounded(acquisition.flat_dark(p, flats, darks), 9).withColumn("value", F.col("value") + 0.0)


@query("SELECT count(*) FILTER (n_bytes > 200) AS n_proj, round(1.7e0 * 80 / 100 * count(*) FILTER (n_bytes > 200), 6) AS ctdi FROM frame_file")
def q41_ctdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquisition.dose(table(spark, sf_dir, "frame_file").withColumnRenamed("n_bytes", "length"), 1.7, 80.0, 200), 6, "ctdi")


@query(f"WITH {ANG_SQL}, n AS (SELECT max(idx) + 1 AS n FROM ang) SELECT idx, angle FROM ang UNION ALL SELECT idx + n, angle / 2 FROM ang, n")
def q42_union_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = angles(spark, sf_dir).select("idx", "angle")
    return acquisition.union_scans([a, a.select("idx", (F.col("angle") / 2).alias("angle"))])


@query(f"{VOL} SELECT round(sum(abs(CAST(value AS DOUBLE))), 0) AS l1, CAST(max(abs(value)) AS DOUBLE) AS linf FROM vol")
def q43_l1_linf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    return metrics.norm(v, 1).select(F.round("norm", 0).alias("l1"), metrics.norm(v, float("inf")).scalar().alias("linf"))


@query(f"{VOL}, {gradient_sql('vol', 'value', 'tv', '1e-8')} SELECT z, y, x, round(value - 0.5 * g / (SELECT sqrt(sum(g * g) + 1e-7) FROM tv), 3) AS value FROM vol JOIN tv USING (z, y, x)")
def q44_tv_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    return rounded(stencil.descent_step(v, stencil.tv_gradient(v), 0.5), 3)


@query(f"""{VOL2}, o AS (SELECT z, y, x, vol.value - vol2.value AS value FROM vol JOIN vol2 USING (z, y, x)), {gradient_sql('vol', 'value', 'a', '1e-6')}, {gradient_sql('o', 'value', 'b', '1e-6')}
SELECT z, y, x, round(0.8 * a.g + 0.2 * b.g, 6) AS value FROM a JOIN b USING (z, y, x)""")
def q45_piccs_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.piccs_gradient(volume(spark, sf_dir), volume(spark, sf_dir, "A"), 0.2))


@query(f"{PAIR} SELECT round(sum(p * r) / greatest(sqrt(sum(p * p)) * sqrt(sum(r * r)), 1e-6), 9) AS c FROM pr")
def q46_update_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cosine(volume(spark, sf_dir), volume(spark, sf_dir, "A"), CELLS), 9, "c")


@query(f"WITH {ANG_SQL} SELECT idx, round(CASE WHEN i0 < 100 THEN 1.0 WHEN i0 < 1000 THEN 1.0 + (i0 - 100) * (3.0 / 900) WHEN i0 < 9000 THEN 4.0 + (i0 - 1000) * (2.0 / 8000) ELSE 6.0 END, 9) AS mapped FROM ang")
def q47_lut_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lookup.piecewise(angles(spark, sf_dir), [(100, 1.0), (1000, 4.0), (9000, 6.0)], "i0").select("idx", "mapped"), 9, "mapped")


@query(f"WITH {PROJ_SQL} SELECT proj_idx, v, u, round(-ln((value + 2000000) / 4000000.0), 9) AS value FROM proj")
def q48_log_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections(spark, sf_dir).select("proj_idx", "v", "u", F.round(acquisition.log_transform(F.col("value") + 2000000, F.lit(4000000.0)), 9).alias("value"))


@query("SELECT reading_id, scan_id, CASE WHEN angle IS NULL THEN NULL WHEN isnan(angle) OR isinf(angle) OR angle < 0 THEN 0 ELSE angle END AS angle FROM projection")
def q49_enforce_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "projection").select("reading_id", "scan_id", acquisition.enforced_positive(F.col("angle")).alias("angle"))


@query(f"{VOL}, s AS (SELECT avg(value) AS m FROM vol) SELECT z, y, x, CASE WHEN value <= 300000000 THEN 0 ELSE round(1e9 / value, 9) END AS value FROM vol")
def q50_inverse_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume(spark, sf_dir).select(*CELLS, F.round(acquisition.inverse_weight(F.col("value") / 1e9, 0.3), 9).alias("value"))


@query(f"{VOL} SELECT CAST(min(value) AS DOUBLE) AS least, CAST(max(value) AS DOUBLE) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 3) AS deviation FROM vol")
def q51_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = metrics.extremes(volume(spark, sf_dir))
    return e.select("least", "most", F.round("mean", 6).alias("mean"), F.round("deviation", 3).alias("deviation"))


@query(f"WITH {ANG_SQL} SELECT idx, angle, row_number() OVER (ORDER BY (angle % 180 + 180) % 180, idx) AS place FROM ang")
def q52_sort_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition.sorted_modulo(angles(spark, sf_dir).select("idx", "angle"), 180.0)


def phantom_sql(rows: list[tuple], turned_centres: bool) -> str:
    values = ", ".join(str(tuple(float(x) for x in r)) for r in rows)
    start = "x - 0" if turned_centres else "x - x0"
    return f"""WITH e AS (SELECT a, b, c, x0, y0, z0, radians(f) AS f, radians(t) AS t, radians(s) AS s, amp FROM (VALUES {values}) v(a, b, c, x0, y0, z0, f, t, s, amp)),
g AS (SELECT CAST(i // 576 AS INT) AS z, CAST(i // 24 % 24 AS INT) AS y, CAST(i % 24 AS INT) AS x FROM range(13824) r(i)),
p AS (SELECT e.*, g.z AS iz, g.y AS iy, g.x AS ix, {"0" if turned_centres else "1"} AS own, g.x * (2e0 / 23) - 1 AS x, g.y * (2e0 / 23) - 1 AS y, g.z * (2e0 / 23) - 1 AS z FROM g, e),
q AS (SELECT *, {start} AS x1, y - own * y0 AS y1, z - own * z0 AS z1 FROM p),
r AS (SELECT *, x1 * cos(f) + y1 * sin(f) AS x2, y1 * cos(f) - x1 * sin(f) AS y2 FROM q),
u AS (SELECT *, y2 * cos(t) + z1 * sin(t) AS y3, z1 * cos(t) - y2 * sin(t) AS z3 FROM r),
w AS (SELECT *, x2 * cos(s) + y3 * sin(s) - (1 - own) * x0 AS x4, y3 * cos(s) - x2 * sin(s) - (1 - own) * y0 AS y4, z3 - (1 - own) * z0 AS z4 FROM u)
SELECT iz AS z, iy AS y, ix AS x, round(CAST(sum(CASE WHEN power(x4 / a, 2) + power(y4 / b, 2) + power(z4 / c, 2) <= 1 THEN amp ELSE 0 END) AS DOUBLE), 9) + 0.0 AS value FROM w GROUP BY 1, 2, 3"""


def phantom(spark: SparkSession, kind: str) -> DataFrame:
    return rounded(acquisition.head_phantom(spark, (24, 24, 24), kind), 9).withColumn("value", F.col("value") + 0.0)


@query(phantom_sql(acquisition.KAK_SLANEY, False))
def q53_phantom_kak_slaney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phantom(spark, "kak-slaney")


@query(phantom_sql([(*r[:9], a) for r, a in zip(acquisition.KAK_SLANEY, acquisition.YU_YE_WANG, strict=True)], False))
def q54_phantom_yu_ye_wang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phantom(spark, "yu-ye-wang")


@query(phantom_sql(acquisition.TOFT_SCHABEL, True))
def q55_phantom_toft_schabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phantom(spark, "toft-schabel")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice FROM lineitem), c AS (SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS gain FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, round(l_extendedprice / gain, 9) AS value FROM t JOIN c USING (l_returnflag, l_linestatus)""")
def q56_keyed_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    gain = t.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("gain"))
    rows = lookup.keyed(t.select("l_orderkey", "l_linenumber", *keys, "l_extendedprice"), gain, keys)
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / F.col("gain"), 9).alias("value"))


@query("""WITH e AS (SELECT vec_id AS proj_idx, CAST(i AS INT) AS i, CAST(e AS DOUBLE) AS e FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))
SELECT proj_idx, CAST(i // 8 * 12 + i % 8 + 3 AS INT) AS i, round(e, 9) + 0.0 AS value FROM e
UNION ALL SELECT DISTINCT proj_idx, CAST(k AS INT), 0.0e0 FROM e, range(96) t(k) WHERE k % 12 < 3 OR k % 12 = 11""")
def q57_zero_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("proj_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("data"))
    wide = acquisition.zero_padded(images, (8, 8), 3, 1)
    return wide.select("proj_idx", F.posexplode("data").alias("i", "value")).withColumn("value", F.round("value", 9) + 0.0)


#: Made-up calibration of two materials, and attenuations that lie on cubics, which their splines give back.
DUAL = {"made_up": {"V_80_140": {"Al": BASIS, "PMMA": [0.3, 0.9, -0.02, 0.01, -0.03, 0.002, 0.001, -0.004, 0.003]}}}
ENERGIES = [10.0, 20.0, 40.0, 60.0, 80.0]
MU = {"Al": (ENERGIES, [2.5 - 0.03 * e + 1e-6 * e**3 for e in ENERGIES]), "PMMA": (ENERGIES, [0.4 - 0.001 * e + 2e-5 * e**2 for e in ENERGIES])}


def cubic_sql(c: list[float]) -> str:
    return " + ".join(f"({k!r}) * {t}" for k, t in zip(c, ("l", "h", "l*l", "l*h", "h*h", "l*l*l", "h*l*l", "l*h*h", "h*h*h"), strict=True))


def two_scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every second embedding as a low-energy view at whole degrees, the others as high-energy ones a quarter further."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("data"))
    return e.where("idx % 2 = 0").withColumn("angle", F.col("idx").cast("double")), e.where("idx % 2 = 1").withColumn("angle", F.col("idx") + F.lit(0.25))


DUAL_SQL = f"""WITH e AS (SELECT vec_id AS idx, CAST(i AS INT) AS i, abs(CAST(e AS DOUBLE)) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
near AS (SELECT h.idx, arg_min(l.idx, (abs(l.idx - h.idx - 0.25e0), l.idx)) AS low FROM (SELECT DISTINCT idx FROM e WHERE idx % 2 = 1) h JOIN (SELECT DISTINCT idx FROM e WHERE idx % 2 = 0) l ON abs(l.idx - h.idx) <= 3 GROUP BY 1),
m AS (SELECT n.idx, a.i, l.v AS l, a.v AS h FROM near n JOIN e a ON a.idx = n.idx JOIN e l ON l.idx = n.low AND l.i = a.i),
d AS (SELECT idx, i, {cubic_sql(DUAL['made_up']['V_80_140']['Al'])} AS al, {cubic_sql(DUAL['made_up']['V_80_140']['PMMA'])} AS pmma FROM m)"""


@query(f"{DUAL_SQL} SELECT idx, i, round(al, 9) + 0.0 AS al, round(pmma, 9) + 0.0 AS pmma FROM d")
def q58_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = acquisition.decomposed(*two_scans(spark, sf_dir), DUAL, "made_up", "V_80_140", ("Al", "PMMA"))
    return both.select("idx", F.posexplode(F.arrays_zip("material1", "material2")).alias("i", "m")).select("idx", "i", (F.round("m.material1", 9) + 0.0).alias("al"), (F.round("m.material2", 9) + 0.0).alias("pmma"))


@query(f"{DUAL_SQL} SELECT idx, i, round((2.5e0 - 0.03e0 * 52 + 1e-6 * 52 * 52 * 52) * al + (0.4e0 - 0.001e0 * 52 + 2e-5 * 52 * 52) * pmma, 9) + 0.0 AS value FROM d")
def q59_monochromatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = acquisition.decomposed(*two_scans(spark, sf_dir), DUAL, "made_up", "V_80_140", ("Al", "PMMA"))
    mono = acquisition.monochromatic(both, MU, ("Al", "PMMA"), 52.0)
    return mono.select("idx", F.posexplode("data").alias("i", "value")).withColumn("value", F.round("value", 9) + 0.0)


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS a, l_discount * 100 AS b, l_tax * 100 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(a, b, c), 6) + 0.0 AS x1, round(a + b + c - least(a, b, c) - greatest(a, b, c), 6) + 0.0 AS x2, round(greatest(a, b, c), 6) + 0.0 AS x3
FROM t WHERE abs(a - b) > 0.5 AND abs(b - c) > 0.5 AND abs(a - c) > 0.5""")
def q60_cubic_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots of the cubics that three columns, where they differ, are the roots of."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    t = t.where((F.abs(a - b) > 0.5) & (F.abs(b - c) > 0.5) & (F.abs(a - c) > 0.5))
    roots = algebra.cubic_roots(F.lit(1.0), -(a + b + c), a * b + b * c + a * c, -(a * b * c))
    return t.select("l_orderkey", "l_linenumber", *[(F.round(roots[k], 6) + 0.0).alias(f"x{k + 1}") for k in range(3)])


@query()
def q61_centre_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scan's readings as the sinogram of one detector row."""
    p = table(spark, sf_dir, "projection")
    deg = F.when(F.col("angle_unit") == "rad", F.degrees("angle")).otherwise(F.col("angle"))
    rows = p.select("scan_id", F.radians(deg).alias("angle"), F.transform("projs", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x.cast("double"), F.lit(0.0)))).alias("row"))
    wide = rows.where(F.abs("angle") < 1e6).withColumn("n", F.size("row"))
    same = wide.join(wide.where("n > 1").groupBy("scan_id").agg(F.max("n").alias("n")), ["scan_id", "n"])
    return rounded(lookup.centre_search(same, 1.0, 1000.0, 1536.0), 6, "cor")


@query(f"{PAIR} SELECT round(sqrt(sum((p - r) * (p - r)) / sum(r * r)), 9) AS error FROM pr")
def q62_relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.relative_error(volume(spark, sf_dir), volume(spark, sf_dir, "A"), CELLS), 9, "error")


@query(f"""{PAIR} SELECT round(sqrt(avg((p - r) * (p - r))), 3) AS rmse, round(covar_samp(p, r) / (stddev_samp(p) * stddev_samp(r)), 9) AS cc,
round(2 * covar_samp(p, r) / (var_samp(p) + var_samp(r)) * (2 * avg(p) * avg(r) / (avg(p) * avg(p) + avg(r) * avg(r))), 9) AS uqi FROM pr""")
def q63_sample_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.sample_quality(volume(spark, sf_dir), volume(spark, sf_dir, "A"), CELLS)
    return q.select(F.round("rmse", 3).alias("rmse"), F.round("cc", 9).alias("cc"), F.round("uqi", 9).alias("uqi"))
