"""Queries of the operators that run in kernels: projectors, filters by FFT, corrections and reconstructions. Those whose
result SQL can state have a twin in ``kernel_sql``.

Their input is the volume and the images derived from the whole tables. They are small (847 voxels, 12 views) so that
each runs in seconds; tests hold the operators against analytic values and dense algebra.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raylattice import geometry
from raylattice.algorithms import reconstruct, regular
from raylattice.operators import acquisition, corrections, filtering, lookup, protons
from raylattice.operators.fields import Field, Projector
from raylattice.plans.derived import NU, NV, NX, NY, NZ, volume
from raylattice.session import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


SHAPE = (NZ, NY, NX)
CONE = geometry.Geometry(SHAPE, (28.0, 44.0, 44.0), (10, 16), (6.0, 6.0), 500.0, 750.0)
PARALLEL = geometry.Geometry(SHAPE, (28.0, 44.0, 44.0), (7, 14), (4.0, 4.0), 500.0, 750.0, "parallel")
VIEWS = [2 * math.pi * i / 12 for i in range(12)]


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("value", F.round("value", digits) + 0.0)


def field(spark: SparkSession, sf_dir: str, flag: str | None = None) -> Field:
    rows = volume(spark, sf_dir, flag).groupBy(F.col("z").alias("k")).agg(F.sort_array(F.collect_list(F.struct("y", "x", "value"))).alias("l"))
    return Field(rows.select("k", F.transform("l", lambda c: c["value"] / 1e9).alias("data")))


def projector(spark: SparkSession, g: geometry.Geometry = CONE, kind: str = "siddon") -> Projector:
    return Projector(g, geometry.views(spark, g, VIEWS), kind)


def long(f: Field) -> DataFrame:
    return rounded(f.df.select("k", F.posexplode("data").alias("i", "value")), 6)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("proj_idx"), F.transform("embedding", lambda x: x.cast("double") + 2).alias("data"))


def flat(df: DataFrame) -> DataFrame:
    return rounded(df.select("proj_idx", F.posexplode("data").alias("i", "value")), 9)


for _name, _g, _kind in (("k01_siddon_cone", CONE, "siddon"), ("k02_siddon_parallel", PARALLEL, "siddon"), ("k03_interpolated_cone", CONE, "interpolated"), ("k04_interpolated_parallel", PARALLEL, "interpolated")):
    QUERIES[_name] = lambda spark, sf_dir, g=_g, kind=_kind: long(projector(spark, g, kind).forward(field(spark, sf_dir)))
for _name, _g, _kind in (("k05_backproject_fdk", CONE, "fdk"), ("k06_backproject_matched", CONE, "matched"), ("k07_backproject_parallel", PARALLEL, "fdk"), ("k08_adjoint", CONE, "siddon")):
    QUERIES[_name] = lambda spark, sf_dir, g=_g, kind=_kind: long(projector(spark, g).adjoint(projector(spark, g).forward(field(spark, sf_dir)), kind))


@query
def k09_ramp_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(filtering.filtered(images(spark, sf_dir), NV, NU, 0.8, 360, 1536.0, 1000.0, "hann"))


@query
def k10_point_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(corrections.per_image(images(spark, sf_dir), (NV, NU), lambda _, p: corrections.point_scatter(p, (0.8, 0.8), [1.0, 0.3, 0.2, 0.1, 1.0, 0.04], 2)))


@query
def k11_object_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [{"thickness": t, "A": 0.05, "alpha": -0.2, "beta": 1.1, "sigma1": 20.0, "sigma2": 12.0, "B": 3.0, "gamma": 0.03} for t in (0.0, 50.0)]
    blank = images(spark, sf_dir).withColumn("blank", F.transform("data", lambda x: x + 1))
    return flat(corrections.per_image(blank, (NV, NU), lambda _, p, b: corrections.object_scatter(p, b, groups, (0.8, 0.8), 0.02, 2), "blank"))


@query
def k12_beam_hardening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(corrections.beam_hardening(images(spark, sf_dir), [(0.0, 0.0), (1.0, 1.1), (2.0, 2.4), (3.0, 4.0)]))


@query
def k13_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(corrections.noisy(images(spark, sf_dir), (NV, NU)))


@query
def k14_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(corrections.ring_removal(images(spark, sf_dir), (NV, NU)))


@query
def k15_flat_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(corrections.flat_detector(images(spark, sf_dir), (NV, NU), 40.0, 1536.0))


@query
def k16_protons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    at = {"px": F.col("l_quantity") - 25, "py": F.col("l_discount") * 400 - 20, "dx": F.col("l_tax") - 0.04, "dy": F.lit(0.0)}
    tracks = t.select(*[at[k].alias(f"{k}_in") for k in at], (at["px"] + 1).alias("px_out"), at["py"].alias("py_out"), at["dx"].alias("dx_out"), at["dy"].alias("dy_out"), (F.col("l_extendedprice") / 1000).alias("wepl"))
    return protons.project(tracks, (20, 25), (2.0, 2.0), 100.0, 200.0)


@query
def k17_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(regular.im3d_denoise(field(spark, sf_dir), SHAPE, 15.0, 10))


@query
def k18_subsets_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition.subsets(table(spark, sf_dir, "events").select(F.col("event_id").alias("idx")), 20, "random", 7)


@query
def k19_spaced_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scan's readings in order of arrival at the detector, at least two degrees apart."""
    p = table(spark, sf_dir, "projection").where("scan_id is not null and angle is not null and not isnan(angle)").dropDuplicates(["reading_id"])
    deg = F.when(F.col("angle_unit") == "rad", F.degrees("angle")).otherwise(F.col("angle"))
    return lookup.spaced_views(p.select("scan_id", F.col("reading_id").alias("idx"), deg.alias("angle")), 2.0)


def reconstructed(spark: SparkSession, sf_dir: str, run, g: geometry.Geometry = CONE) -> DataFrame:
    a = projector(spark, g)
    out = run(a.forward(field(spark, sf_dir)).done(), a)
    return long(out.x if isinstance(out, reconstruct.Result) else out)


def with_prior(b: Field, a: Projector) -> reconstruct.Result:
    return reconstruct.piccs(b, a, 2, reconstruct.fdk(b, a), blocksize=6, tv_steps=3)


R = reconstruct
RECONSTRUCTIONS = {
    "r01_fdk": R.fdk, "r03_sart": partial(R.sart, iterations=1), "r04_sirt": partial(R.sirt, iterations=2), "r05_os_sart": partial(R.os_sart, iterations=2, blocksize=6),
    "r06_os_sart_tv": partial(R.os_sart_tv, iterations=1, blocksize=6, tv_steps=5), "r07_asd_pocs": partial(R.asd_pocs, iterations=2, blocksize=6, tv_steps=3),
    "r07_aw_asd_pocs": partial(R.asd_pocs, iterations=2, blocksize=6, tv_steps=3, delta=-0.005), "r08_bregman_pocs": partial(R.asd_pocs, iterations=2, blocksize=6, tv_steps=3, bregman=0.5, bregman_every=1),
    "r09_pcsd": partial(R.pcsd, iterations=2, blocksize=6, tv_steps=3), "r09_aw_pcsd": partial(R.pcsd, iterations=2, blocksize=6, tv_steps=3, delta=-0.005), "r10_piccs": with_prior,
    "r11_cgls": partial(R.cgls, iterations=2), "r12_lsqr": partial(R.lsqr, iterations=2), "r13_hybrid_lsqr": partial(R.hybrid_lsqr, iterations=2), "r14_lsmr": partial(R.lsmr, iterations=2),
    "r15_irn_tv_cgls": partial(R.irn_tv_cgls, iterations=2, outer=1), "r16_ab_gmres": partial(R.ab_gmres, iterations=2), "r17_ba_gmres": partial(R.ba_gmres, iterations=2),
    "r18_hybrid_flsqr_tv": partial(R.hybrid_flsqr_tv, iterations=2), "r19_fista": partial(R.fista, iterations=2, hyper=4e4, tv_steps=3), "r19_ista": partial(R.ista, iterations=2, hyper=4e4, tv_steps=3),
    "r20_mlem": partial(R.mlem, iterations=2), "r21_osem": partial(R.osem, iterations=1, blocksize=6), "r22_multigrid": partial(R.multigrid_start, levels=1, iterations=1),
}
for _name, _run in RECONSTRUCTIONS.items():
    QUERIES[_name] = lambda spark, sf_dir, run=_run: reconstructed(spark, sf_dir, run)
QUERIES["r02_fbp"] = lambda spark, sf_dir: reconstructed(spark, sf_dir, R.fbp, PARALLEL)
