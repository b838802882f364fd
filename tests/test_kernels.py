import math

import numpy as np
import pytest

from raylattice import geometry as G
from raylattice.algorithms import reconstruct as R
from raylattice.algorithms import regular
from raylattice.functions import algebra
from raylattice.operators import corrections, filtering, kernels, protons
from raylattice.operators.fields import Field, Projector, largest_singular_value

N = 8
CONE = G.Geometry((N, N + 1, N + 2), (32.0, 36.0, 40.0), (9, 11), (6.0, 6.0), 300.0, 450.0)
ANGLES = [2 * math.pi * i / 10 for i in range(10)]


def view(g, alpha=0.0, **kw):
    return dict(zip(G.VIEW_FIELDS, (0, alpha, 0.0, 0.0, g.dso, g.dsd, *g.off_origin, *g.off_detector, *g.rot_detector, g.cor), strict=True)) | kw


def dense(g, kind, angles=ANGLES):
    rows = []
    for a in angles:
        ray, cell, w = kernels.entries(g, view(g, a), kind)
        m = np.zeros((int(np.prod(g.n_detector)), int(np.prod(g.n_voxel))))
        np.add.at(m, (ray, cell), w)
        rows.append(m)
    return np.concatenate(rows)


def test_siddon_lengths_are_exact():
    g = G.Geometry((4, 4, 4), (4.0,) * 3, (4, 4), (1.0, 1.0), 100.0, 200.0, "parallel")
    for alpha in (0.0, math.pi / 2):
        m = dense(g, "siddon", [alpha])
        assert m.sum(1) == pytest.approx(np.full(16, 4.0), abs=1e-6)
    x = np.random.default_rng(0).random((4, 4, 4))
    assert (dense(g, "siddon", [0.0]) @ x.ravel()).reshape(4, 4) == pytest.approx(x.sum(2), abs=1e-6)
    central = dense(G.Geometry((5, 5, 5), (10.0,) * 3, (1, 1), (1.0, 1.0), 100.0, 150.0), "siddon", [0.3])
    assert central.sum() == pytest.approx(10 / math.cos(0.3), rel=1e-3)
    miss = G.Geometry((4, 4, 4), (4.0,) * 3, (1, 1), (1.0, 1.0), 100.0, 200.0, off_detector=(90.0, 0.0))
    assert len(kernels.siddon(miss, view(miss))[0]) == 0


def test_projectors_agree_and_voxel_weights():
    a, b = dense(CONE, "siddon").sum(1), dense(CONE, "interpolated").sum(1)
    inner = a > 0.5 * a.max()
    assert np.abs(a - b)[inner].mean() < 0.06 * a.max()
    g = G.Geometry((3, 3, 3), (3.0,) * 3, (9, 9), (1.0, 1.0), 100.0, 150.0)
    centre = 13
    _, cell, w = kernels.entries(g, view(g), "fdk")
    assert w[cell == centre].sum() == pytest.approx(1.0)
    near = np.bincount(cell, w, 27)
    assert near[centre + 1] == pytest.approx((100 / 99) ** 2)  # a millimetre nearer to the source
    _, cell, w = kernels.entries(g, view(g), "matched")
    assert np.bincount(cell, w, 27)[centre] == pytest.approx(150**3 / (150 * 100**2))
    with pytest.raises(ValueError):
        kernels.entries(g, view(g), "nope")


@pytest.fixture(scope="module")
def scan(spark):
    a = Projector(CONE, G.views(spark, CONE, ANGLES))
    z, y, x = np.meshgrid(*[np.linspace(-1, 1, n) for n in CONE.n_voxel], indexing="ij")
    vol = (x * x + y * y + z * z < 0.7).astype(float) + 0.5 * ((x - 0.2) ** 2 + y * y + z * z < 0.1)
    f = Field.of(spark, vol.reshape(len(vol), -1)).done()
    return a, vol, f, a.forward(f).done(), dense(CONE, "siddon")


def test_distributed_plans_equal_dense_algebra(spark, scan):
    a, vol, f, b, m = scan
    assert b.array().ravel() == pytest.approx(m @ vol.ravel(), abs=1e-9)
    assert a.adjoint(b).array().ravel() == pytest.approx(m.T @ (m @ vol.ravel()), rel=1e-9, abs=1e-9)
    for kind in ("siddon", "interpolated", "fdk", "matched"):
        one = Projector(CONE, a.views, kind)
        for slab_bytes in (0, 8 * 90 * 3):
            cut = Projector(CONE, a.views, kind, slab_bytes)
            assert len(cut.slabs) == (8 if not slab_bytes else 3)
            assert cut.forward(f).array() == pytest.approx(one.forward(f).array(), abs=1e-9)
            assert cut.adjoint(b).array() == pytest.approx(one.adjoint(b).array(), abs=1e-9)
    assert largest_singular_value(a, 12) == pytest.approx(np.linalg.svd(m, compute_uv=False)[0], rel=0.02)


def test_krylov_methods_match_dense_solutions(scan):
    a, vol, _, b, m = scan
    rhs = m @ vol.ravel()

    def dense_cgls(k):
        x, r = np.zeros(m.shape[1]), rhs.copy()
        p = s = m.T @ r
        g = s @ s
        for _ in range(k):
            q = m @ p
            al = g / (q @ q)
            x, r = x + al * p, r - al * q
            s = m.T @ r
            p, g = s + (s @ s) / g * p, s @ s
        return x

    expected = dense_cgls(3)
    assert R.cgls(b, a, 3).x.array().ravel() == pytest.approx(expected, abs=1e-6)
    assert R.lsqr(b, a, 3).x.array().ravel() == pytest.approx(expected, abs=1e-6)
    out = R.cgls(b, a, 3)
    assert out.history == sorted(out.history, reverse=True)
    exact = R.ba_gmres(b, a, 3).x.array().ravel()
    assert np.linalg.norm(m @ exact - rhs) < 0.3 * np.linalg.norm(rhs)


def test_art_and_statistical_methods(scan):
    a, vol, _, b, m = scan
    one = R.mlem(b, a, 1).x.array().ravel()
    norm = m.sum(0)
    forward = m.sum(1)
    ratio = np.divide(m @ vol.ravel(), forward, out=np.zeros_like(forward), where=forward > 0)
    assert one == pytest.approx(np.divide(m.T @ ratio, norm, out=np.zeros_like(norm), where=norm > 1e-12), abs=1e-9)
    for run in (lambda: R.sirt(b, a, 3), lambda: R.os_sart(b, a, 2, blocksize=4, order="random2")):
        out = run()
        assert out.history == sorted(out.history, reverse=True) and out.x.array().min() >= 0
    fdk = R.fdk(b, a).array().reshape(vol.shape)
    assert np.corrcoef(fdk.ravel(), vol.ravel())[0, 1] > 0.7
    with pytest.raises(ValueError):
        R.fbp(b, a)
    with pytest.raises(ValueError):
        R.blocks(a, 2, "nope")
    assert sorted(k for p in R.blocks(a, 4, "angularDistance") for k in p) == list(range(10))


def test_total_variation_plans_agree(spark):
    shape = (6, 5, 4)
    v = np.random.default_rng(2).random(shape)
    f = Field.of(spark, v.reshape(6, -1))
    small = regular.descend(f, shape, 0.3, 2).array()
    assert regular.descend(f, shape, 0.3, 2, whole_bytes=0).array() == pytest.approx(small, abs=1e-9)
    assert regular.denoise(f, shape, 5.0, 3, slab=2, whole_bytes=0).array() == pytest.approx(regular.denoise(f, shape, 5.0, 3).array(), abs=1e-9)
    tv = lambda x: np.abs(np.diff(x, axis=0)).sum() + np.abs(np.diff(x, axis=1)).sum() + np.abs(np.diff(x, axis=2)).sum()
    assert tv(small.reshape(shape)) < tv(v)
    assert tv(regular.rof(v, 15.0, 60)) < tv(v)
    with pytest.raises(ValueError, match="3D"):
        regular.im3d_denoise(f, (6, 20), 1.0)
    eps = 1e-6
    numeric = np.zeros(shape)
    energy = lambda x: np.sqrt(sum(np.diff(x, axis=a, prepend=np.take(x, [0], axis=a)) ** 2 for a in range(3)) + 1e-8).sum()
    for i in np.ndindex(shape):
        d = np.zeros(shape)
        d[i] = eps
        numeric[i] = (energy(v + d) - energy(v - d)) / (2 * eps)
    assert regular.gradient(v) == pytest.approx(numeric, abs=1e-4)


def test_geometry_checks(spark):
    with pytest.raises(TypeError):
        G.Geometry((1, 1, 1), (1.0,) * 3, (1, 1), (1.0, 1.0), 1.0, 2.0, colour=3)
    for bad in ({"dsd": 1.0}, {"mode": "x"}, {"n_voxel": (0, 1, 1)}):
        with pytest.raises(ValueError):
            G.Geometry(**(CONE.__dict__ | bad))
    with pytest.raises(ValueError):
        CONE.with_sizes(n_voxel=(4, 4, 4), d_voxel=(1.0, 1.0, 1.0), s_voxel=(4.0, 4.0, 5.0))
    with pytest.raises(ValueError):
        G.views(spark, CONE, [0.0], nothing=[1])
    with pytest.raises(ValueError):
        G.views(spark, CONE, [float("nan")])
    assert G.rotation_between([1, 0, 0], [0, 0, 1]) @ np.array([1, 0, 0]) == pytest.approx([0, 0, 1])
    yaw, pitch, roll = 0.3, -0.2, 0.1
    r = G.rotation("z", yaw) @ G.rotation("y", pitch) @ G.rotation("x", roll)
    assert G.euler_from_vectors(r[:, 0], r[:, 2]) == pytest.approx((yaw, pitch, roll))
    source = np.array([[300 * math.cos(a), 300 * math.sin(a), 0.0] for a in (0.1, 2.0)])
    free = [r.asDict() for r in G.free_motion(spark, CONE, source, -source / 2).orderBy("proj_idx").collect()]
    for f, a in zip(free, (0.1, 2.0), strict=True):
        for p, q in zip(G.rays(CONE, f), G.rays(CONE, view(CONE, a)), strict=True):
            assert p == pytest.approx(q, abs=1e-6)
    lines = spark.createDataFrame([(1.0, 5.0, 3.0, 0.0, 1.0, 0.0), (7.0, 2.0, 3.0, 1.0, 0.0, 0.0)], "px double, py double, pz double, dx double, dy double, dz double")
    assert G.trajectory_centre(lines) == pytest.approx([1.0, 2.0, 3.0])


def test_flexible_lsqr_uses_gradients_and_splits_off_constants(spark):
    g = G.Geometry((3, 4, 5), (12.0, 16.0, 20.0), (5, 7), (6.0, 6.0), 300.0, 450.0)
    angles = ANGLES[:6]
    m, n, count = dense(g, "siddon", angles), (3, 4, 5), 60
    truth = np.random.default_rng(6).random(n)
    truth[1:, 1:3, 2:] += 2
    d = np.stack([R.differences(e.reshape(n)).ravel() for e in np.eye(count)], 1)
    y = np.random.default_rng(7).random((3, *n))
    assert R.differences_back(y).ravel() == pytest.approx(d.T @ y.ravel())
    rhs = m @ truth.ravel()
    seen = m @ np.ones(count)
    constant = np.full(count, seen @ rhs / (seen @ seen))
    share, u = m.T @ seen / (seen @ seen), rhs - m @ constant
    us, vs, zs, x = [u / np.linalg.norm(u)], [], [], None
    for k in range(3):
        v = m.T @ us[k]
        for q in vs:
            v = v - q @ v * q
        vs.append(v / np.linalg.norm(v))
        w = np.ones(count) if x is None else (((d @ x).reshape(3, -1) ** 2).sum(0) + 1e-6) ** -0.25
        wd = np.tile(w, 3)[:, None] * d
        z = np.linalg.pinv(wd) @ np.linalg.pinv(wd.T) @ (vs[-1] - share * vs[-1].sum())
        zs.append(z - share @ z)
        p = m @ zs[-1]
        for q in us:
            p = p - q @ p * q
        us.append(p / np.linalg.norm(p))
        basis = np.stack(zs, 1)
        c = np.linalg.lstsq(np.vstack([m @ basis, 5.0 * wd @ basis]), np.concatenate([u, np.zeros(3 * count)]), rcond=None)[0]
        x = constant + basis @ c
    a = Projector(g, G.views(spark, g, angles))
    b = Field.of(spark, rhs.reshape(len(angles), -1))
    out = R.hybrid_flsqr_tv(b, a, 3, 5.0)
    assert out.x.array().ravel() == pytest.approx(x, rel=1e-3, abs=1e-3)
    assert out.history[-1] == pytest.approx(np.linalg.norm(rhs - m @ x), rel=1e-3)
    level = R.hybrid_flsqr_tv((a.forward(a.ones(True)) * 3.0).done(), a, 2, 1e6).x.array()
    assert level == pytest.approx(np.full(level.shape, 3.0))


def test_redundancy_weights(spark):
    g = G.Geometry((2, 8, 8), (4.0, 16.0, 16.0), (1, 12), (2.0, 2.0), 300.0, 450.0, off_detector=(0.0, 5.0))
    w = R.offset_weights(g)
    u = (np.arange(12) - 5.5) * 2 + 5
    for i, x in enumerate(u):
        if np.isclose(u, -x).any() and abs(x) < 7:
            assert w[i] + w[np.flatnonzero(np.isclose(u, -x))[0]] == pytest.approx(2.0)
    assert w[-1] == 2.0
    short = list(np.linspace(0, math.pi + 2 * math.atan(12 / 450), 40))
    plain = G.Geometry((2, 8, 8), (4.0, 16.0, 16.0), (1, 12), (2.0, 2.0), 300.0, 450.0)
    a = Projector(plain, G.views(spark, plain, short))
    ones = R.short_scan_weighted(a.ones(False), a).array()
    assert ones.shape == (40, 12) and ones.min() > -1e-9 and ones.max() < 1 + 1e-9 and ones[20].min() > 0.99 and ones[0].max() < 0.01
    full = R.fdk(a.forward(a.ones(True)).done(), a, parker=True).array()
    assert np.isfinite(full).all()


def test_a_resting_detector_stays_where_it_is(spark):
    rest = G.rays(CONE, view(CONE))[1]
    swung = G.static_detector(G.views(spark, CONE, [0.4, -0.7]), CONE).collect()
    moved = G.linear_source(G.views(spark, CONE, [0.0, 0.0]).selectExpr("*", "double(proj_idx * 50 - 20) as s_pos"), CONE).collect()
    for r in swung + moved:
        assert G.rays(CONE, r.asDict())[1] == pytest.approx(rest, abs=1e-9)
    assert G.rays(CONE, swung[0].asDict())[0][0] == pytest.approx([300 * math.cos(0.4), 300 * math.sin(0.4), 0])
    assert sorted(G.rays(CONE, r.asDict())[0][0][1] for r in moved) == pytest.approx([-20, 30])


def test_filters_and_corrections(spark):
    flat = np.ones((1, 2, 64))
    assert np.abs(filtering.filter_rows(flat, "ram_lak", 1.0)[..., 24:40]).max() < 0.05
    with pytest.raises(ValueError):
        filtering.window("nope", 3)
    rng = np.random.default_rng(4)
    image, kernel = rng.random((6, 7)), rng.random((3, 3))
    brute = np.array([[sum(kernel[i, j] * image[v + 1 - i, u + 1 - j] for i in range(3) for j in range(3) if 0 <= v + 1 - i < 6 and 0 <= u + 1 - j < 7) for u in range(7)] for v in range(6)])
    assert corrections.convolved(image, kernel) == pytest.approx(brute)
    images = spark.createDataFrame([(0, [float(x) for x in range(12)]), (1, None), (2, [float("nan")] * 12)], "proj_idx bigint, data array<double>")
    rows = {r["proj_idx"]: r["data"] for r in corrections.ring_removal(images, (2, 6), 1).collect()}
    assert rows[0] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] and rows[1] is None
    noise = corrections.noisy(images.where("proj_idx = 0"), (2, 6), seed=3)
    assert noise.collect() == corrections.noisy(images.where("proj_idx = 0").repartition(3), (2, 6), seed=3).collect()
    clean = corrections.point_scatter(np.full((16, 16), 100.0), (1.0, 1.0), [1, 0.5, 0.1, 0.1, 1, 0.05], 4)
    assert 90 < clean[8, 8] < 100
    filled = corrections.holes_filled(spark.createDataFrame([(0, [1.0, 1.0, 1.0, 1.0, None, 1.0, 1.0, 1.0, 1.0])], "proj_idx bigint, data array<double>"), (3, 3))
    assert filled.first()["data"][4] == pytest.approx(1.0)
    line = corrections.hardening_table(np.array([50.0]), np.array([1.0]), np.array([0.2]), np.array([0.0, 1.0, 5.0]))
    assert line == pytest.approx([0, 0.2, 1.0])


def test_wide_holes_get_a_smooth_surface(spark):
    plane = np.add.outer(np.arange(60.0), 3 * np.arange(70.0))
    holed = plane.copy()
    holed[8:52, 9:61] = np.nan
    holed[0, 0] = np.nan
    out = corrections.holes_filled(spark.createDataFrame([(0, holed.ravel().tolist())], "proj_idx bigint, data array<double>"), (60, 70))
    got = np.array(out.first()["data"]).reshape(60, 70)
    assert got[8:52, 9:61] == pytest.approx(plane[8:52, 9:61], abs=1e-5) and got[0, 0] == pytest.approx(2.0)


def test_straight_protons_land_in_their_pixel(spark):
    schema = ", ".join(f"{c} double" for c in protons.NEEDED)
    rows = [(0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 10.0), (0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 20.0), (99.0, 0.5, 99.0, 0.5, 0.0, 0.0, 0.0, 0.0, 5.0), (0.5, None, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 1.0)]
    out = protons.project(spark.createDataFrame(rows, schema), (4, 4), (1.0, 1.0), 50.0, 200.0).collect()
    assert [(r["pixel"], r["value"], r["rejected"]) for r in out] == [(10, pytest.approx(15.0), 2)]
    assert protons.project(spark.createDataFrame([], schema), (4, 4), (1.0, 1.0), 50.0, 200.0).count() == 0


def test_phantoms_roots_keys_padding_and_places(spark):
    from pyspark.sql import functions as F

    from raylattice.operators import acquisition, lookup
    from raylattice.session import placed

    with pytest.raises(ValueError):
        acquisition.head_phantom(spark, (4, 4, 4), "x")
    head = {(r["z"], r["y"], r["x"]): r["value"] for r in acquisition.head_phantom(spark, (9, 9, 9), "kak-slaney").collect()}
    assert head[4, 4, 4] == pytest.approx(1.02) and head[0, 0, 0] == 0
    rng = np.random.default_rng(5)
    rows = [tuple(float(x) for x in r) for r in rng.normal(size=(50, 4))] + [(1.0, -6.0, 11.0, -6.0), (1.0, 0.0, 0.0, 0.0), (2.0, 0.0, 0.0, -16.0)]
    df = spark.createDataFrame(rows + [(1.0, None, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r["x"] for r in df.select(algebra.cubic_roots(*[F.col(k) for k in "abcd"]).alias("x")).collect()]
    for r, x in zip(rows, got, strict=False):
        true = sorted(z.real for z in np.roots(r) if abs(z.imag) < 1e-7)
        assert x == pytest.approx(true if len(x) == len(true) else [true[0]], abs=1e-6)
    assert got[-1] is None
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    assert lookup.keyed(left, spark.createDataFrame([(1, 5.0), (2, 6.0), (2, 6.0)], "k int, gain double"), ["k"]).count() == 2
    with pytest.raises(Exception, match="no calibration for"):
        lookup.keyed(left, spark.createDataFrame([(1, 5.0)], "k int, gain double"), ["k"]).collect()
    image = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0])], "proj_idx int, data array<double>")
    assert acquisition.zero_padded(image, (2, 2), 1, 2).first()["data"] == [0, 1, 2, 0, 0, 0, 3, 4, 0, 0]
    many = spark.range(5000).withColumn("x", (F.col("id") * 7919) % 1000)
    at = placed(many, "x", "id").orderBy("x", "id").collect()
    assert [r["place"] for r in at] == list(range(5000)) and placed(many.limit(0), "id").count() == 0


def test_nearest_against_brute_force(spark):
    from raylattice.operators import lookup

    rng = np.random.default_rng(9)
    sources = [(i, float(a)) for i, a in enumerate(np.concatenate([rng.normal(0, 1, 300).round(2), [50.0, 50.0, -80.0]]))]
    targets = [(i, float(a)) for i, a in enumerate(np.concatenate([rng.normal(0, 40, 500).round(1), [50.0] * 40]))]
    kind = "idx bigint, angle double"
    s, t = spark.createDataFrame([*sources, (999, None), (998, float("nan"))], kind), spark.createDataFrame([*targets, (999, None)], kind)
    got = {r["t_idx"]: (r["s_idx"], r["delta"]) for r in lookup.nearest(t, s).collect()}
    assert len(got) == len(targets)
    for i, a in targets:
        best = min(abs(a - b) for _, b in sources)
        assert got[i][1] == best and abs(dict(sources)[got[i][0]] - a) == best
    assert lookup.nearest(t, s.limit(0)).count() == 0 and lookup.nearest(t.limit(0), s).count() == 0
    one = spark.createDataFrame([(0, 10.0)], kind).selectExpr("angle", "5.0D as value")
    assert all(abs(r["blank"] - 5) < 1e-9 for r in lookup.interpolate_circular(t.where("angle is not null"), one).collect())


def test_pcsd_against_a_dense_loop(scan):
    a, vol, _, b, m = scan
    rhs = m @ vol.ravel()
    rays = int(np.prod(CONE.n_detector))
    back = dense(CONE, "fdk")
    w = np.where(m.sum(1) <= min(CONE.d_voxel) / 2, 0, 1 / np.maximum(m.sum(1), 1e-300))
    out = R.pcsd(b, a, 3, blocksize=5, tv_steps=2, epsilon=1.0)
    x, first, before, beta = np.zeros(m.shape[1]), None, np.linalg.norm(rhs), 1.0
    for k in range(3):
        if before**2 > 1.0:
            for part in (slice(0, 5 * rays), slice(5 * rays, None)):
                v = back[part].sum(0)
                v = np.where(v <= 0, 0, 1 / np.maximum(v, 1e-300))
                x = np.maximum(x + beta * v * (back[part].T @ ((rhs[part] - m[part] @ x) * w[part])), 0)
        dd = np.linalg.norm(m @ x - rhs)
        assert out.history[k] == pytest.approx(dd, rel=1e-6)
        length, first = (1.0, dd) if first is None else (before / first, first)
        for _ in range(2):
            g = regular.gradient(x.reshape(vol.shape)).ravel()
            x = x - length * g / np.sqrt((g * g).sum() + 1e-7)
        before = np.linalg.norm(m @ x - rhs)
        beta *= 0.99
    assert out.x.array().ravel() == pytest.approx(x, abs=1e-6)
    # The descent goes on once the data step has stopped.
    still = R.pcsd(b, a, 2, blocksize=5, tv_steps=2, epsilon=1e12)
    assert np.isfinite(still.history).all() and len(still.history) >= 1


def test_coarse_volumes_are_enlarged_slice_by_slice(spark):
    x = np.arange(2 * 3 * 2, dtype=float).reshape(2, 3, 2)
    got = R.enlarged(Field.of(spark, x.reshape(2, -1)), (2, 3, 2), (5, 7, 4)).array().reshape(5, 7, 4)
    pick = np.ix_(*[np.minimum(np.arange(k) * c // k, c - 1) for k, c in zip((5, 7, 4), (2, 3, 2), strict=True)])
    assert (got == x[pick]).all()


def test_dual_energy_from_two_scans_and_splines(spark):
    from raylattice.operators import acquisition

    xs, ys = [0.0, 1.0, 2.5, 4.0, 7.0], [x**3 - 2 * x for x in (0.0, 1.0, 2.5, 4.0, 7.0)]
    assert [algebra.not_a_knot(xs, ys, x) for x in (0.5, 3.3, 8.0)] == pytest.approx([x**3 - 2 * x for x in (0.5, 3.3, 8.0)])
    assert algebra.not_a_knot([1.0, 3.0], [2.0, 6.0], 2.0) == pytest.approx(4.0)
    kind = "idx bigint, angle double, data array<double>"
    low = spark.createDataFrame([(k, 10.0 * k, [float(k), 1.0]) for k in range(5)], kind)
    high = spark.createDataFrame([(k, a, [2.0, 3.0]) for k, a in enumerate((0.0, 12.5, 34.0, 90.0))], kind)
    cal = {"S": {"V_80_140": {"Al": [1.0, *[0.0] * 8], "PMMA": [0.0, 1.0, *[0.0] * 7]}}}
    run = lambda *a: {r["idx"]: (r["material1"], r["material2"]) for r in acquisition.decomposed(low, high, cal, "S", "V_80_140", ("Al", "PMMA"), *a).collect()}
    assert {k: v[0][0] for k, v in run().items()} == {0: 0.0, 1: 1.0, 2: 3.0, 3: 4.0} and run()[1][1] == [2.0, 3.0]
    assert {k: v[0][0] for k, v in run("skip", 3.0).items()} == {0: 0.0, 1: 1.0}
    assert {k: v[0][0] for k, v in run("linear").items()} == pytest.approx({0: 0.0, 1: 1.25, 2: 3.4, 3: 4.0})
    for bad in (("T", "V_80_140"), ("S", "V_1_2")):
        with pytest.raises(KeyError, match="known are"):
            acquisition.decomposed(low, high, cal, *bad, ("Al", "PMMA"))
    table = {"Al": ([10.0, 20.0, 30.0, 40.0], [4.0, 3.0, 2.0, 1.0]), "PMMA": ([10.0, 40.0], [1.0, 1.0])}
    both = acquisition.decomposed(low, high, cal, "S", "V_80_140", ("Al", "PMMA"))
    assert acquisition.monochromatic(both, table, ("Al", "PMMA"), 25.0).where("idx = 1").first()["data"] == pytest.approx([2.5 * 1 + 2, 2.5 * 1 + 3])
    with pytest.raises(ValueError):
        acquisition.monochromatic(both, table, ("Al", "PMMA"), 50.0)


def test_centre_search_finds_a_shifted_axis(spark):
    from raylattice.operators import lookup

    pitch, dso, dsd, nu, n = 1.0, 500.0, 750.0, 129, 180
    u = (np.arange(nu) - (nu - 1) / 2) * pitch
    for shift in (0.0, 2.4):
        rows = []
        for k in range(n):
            a = 2 * np.pi * k / n
            row = np.zeros(nu)
            for x, y, r in ((12.0, 5.0, 6.0), (-15.0, -9.0, 4.0), (3.0, -20.0, 5.0)):
                px, py = x * np.cos(a) + y * np.sin(a), -x * np.sin(a) + y * np.cos(a)
                at = (py) * dsd / (dso - px) + shift
                row += np.exp(-(((u - at) / (r * 1.5)) ** 2) / 2)
            rows.append((7, float(a), [float(x) for x in row]))
        views = spark.createDataFrame([*rows, (7, None, None), (None, 0.0, [1.0])], "scan_id int, angle double, row array<double>")
        got = [tuple(r) for r in lookup.centre_search(views, pitch, dso, dsd).collect()]
        assert len(got) == 1 and got[0][0] == 7 and abs(abs(got[0][1]) - shift * dso / dsd) < 0.1


def test_displaced_detectors_are_padded_before_the_filter(spark):
    g = G.Geometry((2, 24, 24), (8.0, 96.0, 96.0), (2, 40), (6.0, 4.0), 500.0, 750.0)
    angles = [2 * math.pi * i / 60 for i in range(60)]
    y, x = np.meshgrid(*[np.arange(24) - 11.5] * 2, indexing="ij")
    truth = np.stack([((x - 3) ** 2 + (y + 2) ** 2 < 60).astype(float)] * 2)
    f = Field.of(spark, truth.reshape(2, -1)).done()
    errors = {}
    for off, nu in ((0.0, 40), (30.0, 32), (-30.0, 32)):
        h = G.Geometry(**(g.__dict__ | {"n_detector": (2, nu), "off_detector": (0.0, off)}))
        a = Projector(h, G.views(spark, h, angles))
        errors[off] = np.sqrt(((R.fdk(a.forward(f).done(), a).array().reshape(truth.shape) - truth)[:, 4:20, 4:20] ** 2).mean())
    assert errors[30.0] < 1.5 * errors[0.0] + 0.02 and errors[-30.0] < 1.5 * errors[0.0] + 0.02


def test_orders_feet_means_and_flat_detectors(spark):
    assert R.farthest_first([0.0, 1.0, 2.0, 3.0, 4.0]) == [0, 3, 4, 1, 2]
    assert R.farthest_first([]) == []
    assert G.foot_on_line([1, 2, 3], [0, 0, 0], [0, 0, 2]).tolist() == [0, 0, 3]
    with pytest.raises(ValueError):
        G.foot_on_line([1, 2, 3], [0, 0, 0], [0, 0, 0])
    image = np.arange(12.0).reshape(3, 4)
    df = spark.createDataFrame([(0, image.ravel().tolist()), (1, None)], "proj_idx int, data array<double>")
    got = {r["proj_idx"]: r["data"] for r in corrections.mean3(df, (3, 4)).collect()}
    wide = np.pad(image, 1, mode="symmetric")
    assert got[1] is None and got[0] == pytest.approx([wide[i : i + 3, j : j + 3].mean() for i in range(3) for j in range(4)])
    ramp = spark.createDataFrame([(0, [float(k) for k in range(8)])], "proj_idx int, data array<double>")
    fine = corrections.flat_detector(ramp, (1, 8), 4.0, 1000.0, oversample=2, arc_pitch=4.0).first()["data"]
    u = (np.arange(16) - 7.5) * 2.0
    assert fine == pytest.approx(np.clip(1000 * np.arctan(u / 1000) / 4 + 3.5, 0, 7))
