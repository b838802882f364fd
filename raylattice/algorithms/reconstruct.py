"""Reconstruction algorithms: driver loops over distributed fields. Scalars come back one aggregate at a time."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from raylattice.algorithms import regular
from raylattice.geometry import Geometry
from raylattice.operators import acquisition, filtering
from raylattice.operators.fields import Field, Projector, union


@dataclass
class Result:
    """The volume and the residual norms by iteration."""

    x: Field
    history: list[float] = field(default_factory=list)


def zeros(a: Projector) -> Field:
    return (a.ones(True) * 0.0).done()


def ids(a: Projector) -> list[int]:
    """View numbers: a scan's views, bounded by its acquisition."""
    return [int(v["proj_idx"]) for v in a.rows]


def angular_order(angles: list[float]) -> list[int]:
    """Greedy order: next the angle whose difference from the last is closest to a right angle."""
    left, order = list(range(1, len(angles))), [0] if angles else []
    while left:
        diff = [abs(abs(angles[i] - angles[order[-1]]) % np.pi - np.pi / 2) for i in left]
        order.append(left.pop(int(np.argmin(diff))))
    return order


def farthest_first(means: list[float]) -> list[int]:
    """From the first on, next the one with the largest difference, on the circle, from any taken before."""
    order = [0] if means else []
    while len(order) < len(means):
        left = [i for i in range(len(means)) if i not in order]
        far = [max(abs((means[i] - means[j] + np.pi) % (2 * np.pi) - np.pi) for j in order) for i in left]
        order.append(left[int(np.argmax(np.round(far, 12)))])
    return order


def blocks(a: Projector, size: int, order: str = "ordered", seed: int = 0) -> list[list[int]]:
    """View numbers in blocks: ``ordered``, ``random`` blocks, ``random2`` views, ``angularDistance``, or ``farthest``: blocks
    of neighbouring angles, next the one whose mean angle is the furthest from any before."""
    ks = ids(a)
    rng = np.random.default_rng(seed)
    if order == "random2":
        ks = [ks[i] for i in rng.permutation(len(ks))]
    elif order == "angularDistance":
        alpha = {int(v["proj_idx"]): v["alpha"] for v in a.rows}
        ks = [ks[i] for i in angular_order([alpha[k] for k in ks])]
    elif order == "farthest":
        alpha = {int(v["proj_idx"]): v["alpha"] for v in a.rows}
        ks = sorted(ks, key=lambda k: alpha[k])
        out = [ks[i : i + size] for i in range(0, len(ks), size)]
        return [out[i] for i in farthest_first([float(np.mean([alpha[k] for k in p])) for p in out])]
    elif order not in ("ordered", "random"):
        raise ValueError(f"unknown order {order!r}")
    out = [ks[i : i + size] for i in range(0, len(ks), size)]
    return [out[i] for i in rng.permutation(len(out))] if order == "random" else out


def fdk(b: Field, a: Projector, name: str = "ram_lak", parker: bool = False, offset: bool = True) -> Field:
    """Weighted, filtered and backprojected views of a cone beam. ``parker`` weighs a short scan's redundant rays,
    ``offset`` those of a laterally displaced detector."""
    if a.g.mode != "cone":
        raise ValueError("this is for cone beams; use fbp")
    if parker:
        b = short_scan_weighted(b, a)
    return filtered_backprojection(b, a, name, offset)


def short_scan_weighted(b: Field, a: Projector) -> Field:
    """The views times their Parker weights; the scan starts at the smallest alpha."""
    from pyspark.sql import functions as F

    g, half = a.g, math.atan(a.g.n_detector[1] * a.g.d_detector[1] / 2 / a.g.dsd)
    nu, du = g.n_detector[1], g.d_detector[1]
    first, last = a.views.agg(F.min("alpha"), F.max("alpha")).first()
    over = max(0.0, (last - first) - math.pi - 2 * half)
    fan = F.atan((F.col("u") - (nu - 1) / 2) * du / g.dsd)
    rows = a.views.select(F.col("proj_idx").cast("int").alias("k"), (F.col("alpha") - first).alias("beta"), F.explode(F.sequence(F.lit(0), F.lit(nu - 1))).alias("u"))
    rows = rows.select("k", F.struct("u", filtering.parker_weight(F.col("beta"), fan, half, over).alias("w")).alias("uw"))
    rows = rows.groupBy("k").agg(F.sort_array(F.collect_list("uw")).alias("uw")).select("k", F.flatten(F.array_repeat(F.col("uw.w"), g.n_detector[0])).alias("data"))
    return b * Field(rows)


def offset_weights(g: Geometry) -> np.ndarray:
    """Weights along u of a displaced detector: 0 to 2 across the overlap about the axis; 1 without displacement."""
    off = g.off_detector[1]
    if not off:
        return np.ones(g.n_detector[1])
    scale = g.dso / g.dsd
    t = ((np.arange(g.n_detector[1]) - (g.n_detector[1] - 1) / 2) * g.d_detector[1] + off) * scale
    theta = max((g.s_detector[1] / 2 - abs(off)) * scale, 1e-9)
    t = t if off > 0 else -t
    return np.where(t < -theta, 0.0, np.where(t > theta, 2.0, np.sin(np.pi / 2 * np.arctan(t / g.dso) / math.atan(theta / g.dso)) + 1))


def fbp(b: Field, a: Projector, name: str = "ram_lak") -> Field:
    if a.g.mode != "parallel":
        raise ValueError("this is for parallel beams; use fdk")
    return filtered_backprojection(b, a, name) * (a.g.dso / a.g.dsd)


def filtered_backprojection(b: Field, a: Projector, name: str, offset: bool = True) -> Field:
    from pyspark.sql import functions as F

    g = a.g
    (nv, nu), (dv, du) = g.n_detector, g.d_detector
    weight = None
    if g.mode == "cone":
        v = (np.arange(nv) - (nv - 1) / 2) * dv + g.off_detector[0]
        u = (np.arange(nu) - (nu - 1) / 2) * du + g.off_detector[1]
        weight = g.dsd / np.sqrt(g.dsd**2 + u**2 + v[:, None] ** 2)
        weight = weight * offset_weights(g) if offset else weight
    # A laterally displaced detector's rows go on with zeros to the mirror place of their far end, else the filter's tail
    # would be cut at the near one.
    images, off = b.df, g.off_detector[1]
    pad = int(2 * abs(off) / du) if g.mode == "cone" and offset else 0
    if pad:
        left, right, shift = (pad, 0, -pad * du / 2) if off > 0 else (0, pad, pad * du / 2)
        images, weight, nu = acquisition.zero_padded(images, (nv, nu), left, right), np.pad(weight, [(0, 0), (left, right)]), nu + pad
        wide = replace(g, n_detector=(nv, nu), off_detector=(g.off_detector[0], off + shift))
        a = Projector(wide, a.views.withColumn("off_u", F.col("off_u") + shift), a.kind, a.slab_bytes)
    rows = filtering.filtered(images.withColumnRenamed("k", "proj_idx"), nv, nu, du, len(ids(a)), g.dsd, g.dso, name, weight)
    return a.adjoint(Field(rows.select(F.col("proj_idx").cast("int").alias("k"), "data")), "fdk").done()


def weights(a: Projector, parts: list[list[int]]) -> tuple[Field, list[Field]]:
    """Row weights 1 / A 1 (0 for rays that hardly touch the volume) and, per block, voxel weights 1 / A' 1."""
    w = a.forward(a.ones(True)).inverse(min(a.g.d_voxel) / 2).done()
    v = [a.only(p).adjoint(a.only(p).ones(False), "fdk").inverse().done() for p in parts]
    return w, v


def art(
    b: Field, a: Projector, iterations: int, blocksize: int = 20, relax: float = 1.0, shrink: float = 1.0, order: str = "ordered", positive: bool = True,
    x: Field | None = None, after: Callable[[Field, int], Field] | None = None, nesterov: bool = False, seed: int = 0,
) -> Result:
    """Block by block x += relax V_j A_j' W_j (b_j - A_j x), not below 0; ``shrink`` multiplies ``relax`` after each
    iteration and ``after`` runs then. One block is SIRT, one view a block SART, else OS-SART."""
    parts = blocks(a, blocksize, order, seed)
    w, v = weights(a, parts)
    out = Result(x or zeros(a))
    momentum, last = 1.0, out.x
    for i in range(iterations):
        x = out.x
        for part, vj in zip(parts, v, strict=True):
            sub = a.only(part)
            r = (b.rows(part) - sub.forward(x)) * w.rows(part)
            x = x.plus(relax, sub.adjoint(r, "fdk") * vj)
            x = (x.positive() if positive else x).done()
        if nesterov:
            step = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            x, last, momentum = x.plus((momentum - 1) / step, x - last).done(), x, step
        out.x = after(x, i) if after else x
        out.history.append((b - a.forward(out.x)).norm())
        relax *= shrink
    return out


def sart(b: Field, a: Projector, iterations: int, **kw) -> Result:
    return art(b, a, iterations, blocksize=1, **kw)


def sirt(b: Field, a: Projector, iterations: int, **kw) -> Result:
    return art(b, a, iterations, blocksize=1 << 30, **kw)


def os_sart(b: Field, a: Projector, iterations: int, blocksize: int = 20, **kw) -> Result:
    return art(b, a, iterations, blocksize=blocksize, **kw)


def os_sart_tv(b: Field, a: Projector, iterations: int, blocksize: int = 20, tv_weight: float = 50.0, tv_steps: int = 50, **kw) -> Result:
    """OS-SART with a denoising step after each iteration (SART-TV with blocks of one view)."""
    return art(b, a, iterations, blocksize=blocksize, after=lambda x, _: regular.im3d_denoise(x, a.g.n_voxel, tv_weight, tv_steps).done(), **kw)


def asd_pocs(
    b: Field, a: Projector, iterations: int, blocksize: int = 1, alpha: float = 0.002, tv_steps: int = 25, epsilon: float | None = None, r_max: float = 0.95,
    alpha_red: float = 0.95, beta: float = 1.0, beta_red: float = 0.99, delta: float | None = None, prior: Field | None = None, share: float = 0.2,
    bregman: float = 0.0, bregman_every: int = 5,
) -> Result:
    """Data step, then total-variation descent scaled to it; stops when the two pull against each other.

    ``delta`` gives the adaptive form, ``prior`` the prior-image form (PICCS), ``bregman`` the form that adds that
    share of the residual to the data every few iterations.
    """
    parts = blocks(a, blocksize)
    w, v = weights(a, parts)
    if epsilon is None:
        epsilon = 0.2 * (a.forward(fdk(b, a) if a.g.mode == "cone" else fbp(b, a)) - b).norm()
    out = Result(zeros(a))
    step = alpha
    for i in range(iterations):
        start = out.x
        x = start
        for part, vj in zip(parts, v, strict=True):
            sub = a.only(part)
            x = x.plus(beta, sub.adjoint((b.rows(part) - sub.forward(x)) * w.rows(part), "fdk") * vj).positive().done()
        dd = (a.forward(x) - b).norm()
        dp = (x - start).done()
        dpn = dp.norm()
        if i == 0:
            step = alpha * dpn
        y = regular.descend(x, a.g.n_voxel, step, tv_steps, delta, prior, share)
        dg = (y - x).done()
        dgn = dg.norm()
        if dgn > r_max * dpn and dd > epsilon:
            step *= alpha_red
        beta *= beta_red
        out.x = y
        out.history.append(dd)
        c = dg.dot(dp) / max(dgn * dpn, 1e-6)
        if (c < -0.99 and dd <= epsilon) or beta < 0.005:
            break
        if bregman and (i + 1) % bregman_every == 0:
            b = b.plus(bregman, b - a.forward(y)).done()
    return out


def piccs(b: Field, a: Projector, iterations: int, prior: Field, **kw) -> Result:
    return asd_pocs(b, a, iterations, prior=prior, **kw)


def pcsd(b: Field, a: Projector, iterations: int, blocksize: int = 1, tv_steps: int = 25, epsilon: float | None = None, delta: float | None = None, beta: float = 1.0, beta_red: float = 0.99) -> Result:
    """Projection-controlled descent: the descent's length is the residual before the data step over that after the first
    one (1 at first); the data step runs only while the squared residual exceeds ``epsilon``."""
    parts = blocks(a, blocksize)
    w, v = weights(a, parts)
    if epsilon is None:
        epsilon = 0.2 * (a.forward(fdk(b, a) if a.g.mode == "cone" else fbp(b, a)) - b).norm()
    out = Result(zeros(a))
    first = None
    before = b.norm()
    for _ in range(iterations):
        start = x = out.x
        if before**2 > epsilon:
            for part, vj in zip(parts, v, strict=True):
                sub = a.only(part)
                x = x.plus(beta, sub.adjoint((b.rows(part) - sub.forward(x)) * w.rows(part), "fdk") * vj).positive().done()
        dd = (a.forward(x) - b).norm()
        length = 1.0 if first is None else before / max(first, 1e-300)
        first = dd if first is None else first
        y = regular.descend(x, a.g.n_voxel, length, tv_steps, delta).done()
        out.history.append(dd)
        c = (y - x).dot(x - start) / max((y - x).norm() * (x - start).norm(), 1e-6)
        out.x, before = y, (a.forward(y) - b).norm()
        beta *= beta_red
        if (c < -0.99 and dd <= epsilon) or beta < 0.005:
            break
    return out


def cgls(b: Field, a: Projector, iterations: int, x: Field | None = None) -> Result:
    """Conjugate gradients for least squares with the exact adjoint; restarts from the last good volume when the
    residual grows, and ends if that does not help."""
    out = Result(x or zeros(a))
    fresh = True
    p = r = None
    gamma = 0.0
    while len(out.history) < iterations:
        if fresh:
            r = (b - a.forward(out.x)).done()
            p = a.adjoint(r).done()
            gamma, before = p.dot(p), r.norm()
        if gamma == 0:
            break
        q = a.forward(p).done()
        alpha = gamma / max(q.dot(q), 1e-300)
        x, r = out.x.plus(alpha, p).done(), r.plus(-alpha, q).done()
        now = r.norm()
        if now > before * (1 + 1e-12):
            if fresh:
                break
            fresh = True
            continue
        out.x, before, fresh = x, now, False
        out.history.append(now)
        s = a.adjoint(r).done()
        after = s.dot(s)
        p, gamma = s.plus(after / gamma, p).done(), after
    return out


def bidiagonal(b: Field, a: Projector, steps: int, exact: bool = True) -> tuple[list[Field], list[Field], np.ndarray]:
    """Golub-Kahan: (U, V, B) with A V = U B; re-orthogonalised if ``exact``. Small matrices stay on the driver."""
    beta = b.norm()
    us, vs = [(b * (1 / max(beta, 1e-300))).done()], []
    m = np.zeros((steps + 1, steps))
    v = a.adjoint(us[0])
    for k in range(steps):
        if k:
            v = v.plus(-m[k, k - 1], vs[-1])
        v = orthogonal(v.done(), vs) if exact else v.done()
        m[k, k] = v.norm()
        if m[k, k] < 1e-12:
            return us, vs, m[: k + 1, :k]
        vs.append((v * (1 / m[k, k])).done())
        u = a.forward(vs[-1]).plus(-m[k, k], us[-1]).done()
        u = orthogonal(u, us) if exact else u
        m[k + 1, k] = u.norm()
        if m[k + 1, k] < 1e-12:
            return us, vs, m[: k + 2, : k + 1]
        us.append((u * (1 / m[k + 1, k])).done())
        v = a.adjoint(us[-1])
    return us, vs, m


def orthogonal(x: Field, basis: list[Field]) -> Field:
    for q in basis:
        x = x.plus(-x.dot(q), q)
        x = x.done()
    return x


def combination(c: np.ndarray, basis: list[Field]) -> Field:
    out = basis[0] * float(c[0])
    for k, q in zip(c[1:], basis[1:], strict=False):
        out = out.plus(float(k), q)
    return out.done()


def lsqr(b: Field, a: Projector, iterations: int, damping: float = 0.0) -> Result:
    """Least squares on the Krylov space of Golub-Kahan; the residual comes from the small problem."""
    return hybrid_lsqr(b, a, iterations, damping, exact=False)


def hybrid_lsqr(b: Field, a: Projector, iterations: int, damping: float | None = None, noise: float | None = None, exact: bool = True) -> Result:
    """Tikhonov on the projected problem. ``damping`` fixes the parameter; else ``noise`` (relative) chooses it by
    the discrepancy, or generalised cross validation does."""
    us, vs, m = bidiagonal(b, a, iterations, exact)
    if not vs:
        return Result(zeros(a))
    beta = b.norm()
    u, s, vt = np.linalg.svd(m, full_matrices=True)
    rhs = u.T @ np.eye(len(m), 1)[:, 0] * beta
    k = len(s)
    if damping is None:
        lam = np.geomspace(max(s[0], 1e-12) * 1e-6, max(s[0], 1e-12), 200)
        filt = lam[:, None] ** 2 / (s**2 + lam[:, None] ** 2)
        misfit = ((filt * rhs[:k]) ** 2).sum(1) + (rhs[k:] ** 2).sum()
        damping = float(lam[np.argmin(np.abs(misfit - (noise * beta) ** 2)) if noise else np.argmin(misfit / (1 + filt.sum(1)) ** 2)])
    y = vt.T[:, :k] @ (s / (s**2 + damping**2) * rhs[:k])
    history = [float(np.sqrt(max(beta**2 - (rhs[:j] ** 2).sum(), 0))) for j in range(1, k + 1)]
    return Result(combination(y, vs), history)


def lsmr(b: Field, a: Projector, iterations: int, damping: float = 1.0) -> Result:
    """The iterate of the same Krylov space that makes the normal equations' residual A'r smallest."""
    us, vs, m = bidiagonal(b, a, iterations + 1, True)
    k = min(len(vs), iterations)
    if not k:
        return Result(zeros(a))
    normal = m.T @ m + damping**2 * np.eye(m.shape[1])
    y = np.linalg.lstsq(normal[:, :k], (m.T @ np.eye(len(m), 1)[:, 0] * b.norm()), rcond=None)[0]
    x = combination(y, vs)
    return Result(x, [(b - a.forward(x)).norm()])


def irn_tv_cgls(b: Field, a: Projector, iterations: int, outer: int = 4, weight: float = 5.0) -> Result:
    """Total variation by reweighted least squares: per outer round weights (|grad x|² + 1e-6)^(-1/4) and a CGLS on
    the data stacked with the weighted forward differences, whose last slice is 0."""
    g = a.g.n_voxel
    out = Result(zeros(a))

    def penalty(x: Field, at: Field) -> Field:
        def run(v: np.ndarray, p: np.ndarray) -> np.ndarray:
            return differences_back(weight**2 * ((differences(p) ** 2).sum(0) + 1e-6) ** -0.5 * differences(v))

        return regular.local(x, at, g, run)

    for _ in range(outer):
        at, x = out.x, out.x
        s = (a.adjoint(b - a.forward(x)) - penalty(x, at)).done()
        p, gamma = s, s.dot(s)
        for _ in range(iterations):
            if gamma < 1e-300:
                break
            q = (a.adjoint(a.forward(p)) + penalty(p, at)).done()
            alpha = gamma / max(p.dot(q), 1e-300)
            x, s = x.plus(alpha, p).done(), s.plus(-alpha, q).done()
            after = s.dot(s)
            p, gamma = s.plus(after / gamma, p).done(), after
        out.x = x
        out.history.append((b - a.forward(x)).norm())
    return out


def gmres(b: Field, a: Projector, iterations: int, side: str, back: str | None = None) -> Result:
    """GMRES with an unmatched backprojector B (``fdk`` or ``matched``; the exact adjoint if None): ``AB`` solves
    A B y = b and x = B y, ``BA`` solves B A x = B b."""

    def b_(f: Field) -> Field:
        return a.adjoint(f, back)

    start = b if side == "AB" else b_(b).done()
    beta = start.norm()
    basis = [(start * (1 / max(beta, 1e-300))).done()]
    h = np.zeros((iterations + 1, iterations))
    k = 0
    for k in range(iterations):
        w = (a.forward(b_(basis[k])) if side == "AB" else b_(a.forward(basis[k]))).done()
        for j, q in enumerate(basis):
            h[j, k] = w.dot(q)
            w = w.plus(-h[j, k], q).done()
        h[k + 1, k] = w.norm()
        if h[k + 1, k] < 1e-10:
            break
        basis.append((w * (1 / h[k + 1, k])).done())
    y = np.linalg.lstsq(h[: k + 2, : k + 1], np.eye(k + 2, 1)[:, 0] * beta, rcond=None)[0]
    x = combination(y, basis[: k + 1])
    x = b_(x).done() if side == "AB" else x
    return Result(x, [(b - a.forward(x)).norm()])


def ab_gmres(b: Field, a: Projector, iterations: int, back: str | None = None) -> Result:
    return gmres(b, a, iterations, "AB", back)


def ba_gmres(b: Field, a: Projector, iterations: int, back: str | None = None) -> Result:
    return gmres(b, a, iterations, "BA", back)


def inner_lsqr(apply: Callable[[np.ndarray], np.ndarray], back: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int = 50, tol: float = 1e-6) -> np.ndarray:
    """The least-squares solution of smallest norm by LSQR on arrays; ``back`` is the transpose of ``apply``. Ends after
    ``steps`` or once |r| / |b| or |A'r| / (|A| |r|) is at most ``tol``."""
    beta = start = np.linalg.norm(b)
    x = np.zeros_like(back(b))
    if not beta:
        return x
    u = b / beta
    v = back(u)
    alpha = np.linalg.norm(v)
    if not alpha:
        return x
    v = v / alpha
    w, phi, rho_, size2 = v, beta, alpha, 0.0
    for _ in range(steps):
        u = apply(v) - alpha * u
        beta = np.linalg.norm(u)
        u = u / beta if beta else u
        size2 += alpha**2 + beta**2
        next_v = back(u) - beta * v
        after = np.linalg.norm(next_v)
        rho = math.hypot(rho_, beta)
        c, s = rho_ / rho, beta / rho
        x = x + c * phi / rho * w
        phi, rho_ = s * phi, -c * after
        if not beta or not after or phi <= tol * start or after * abs(c) <= tol * math.sqrt(size2):
            break
        v, alpha = next_v / after, after
        w = v - s * after / rho * w
    return x


def differences(v: np.ndarray) -> np.ndarray:
    """Forward differences along each axis, stacked; the last one of an axis is 0."""
    return np.stack([np.diff(v, axis=k, append=np.take(v, [-1], axis=k)) for k in range(v.ndim)])


def differences_back(d: np.ndarray) -> np.ndarray:
    """The transpose of ``differences``."""
    total = np.zeros(d.shape[1:])
    for k, x in enumerate(d):
        x = x.copy()
        x[tuple(slice(-1, None) if i == k else slice(None) for i in range(x.ndim))] = 0
        total -= np.diff(x, axis=k, prepend=0)
    return total


def hybrid_flsqr_tv(b: Field, a: Projector, iterations: int, damping: float = 1.0) -> Result:
    """Flexible LSQR with total variation: with L = W D, forward differences weighted by (|grad x|² + 1e-6)^(-1/4) of the
    volume so far (1 at first), each direction goes through the pseudo-inverses of L' and L, an LSQR of 50 steps each.
    Constants, which L doesn't see, are split off and fitted exactly. The projected problem is damped by L on the basis.
    Small volumes only: the weighting runs in one task."""
    g = a.g.n_voxel
    ones = a.ones(True).done()
    seen = a.forward(ones).done()
    size2 = max(seen.dot(seen), 1e-300)
    constant = (ones * (seen.dot(b) / size2)).done()
    share = (a.adjoint(seen) * (1 / size2)).done()  # share'x is the constant whose images are closest to those of x
    u = b.plus(-seen.dot(b) / size2, seen).done()
    beta = u.norm()
    x, history = constant, [beta]
    if beta <= 1e-12 * max(b.norm(), 1e-300):
        return Result(x, history)
    us, zs, vs, history = [(u * (1 / beta)).done()], [], [], []
    m = np.zeros((iterations + 1, iterations))
    for k in range(iterations):
        v = orthogonal(a.adjoint(us[k]).done(), vs)
        size = v.norm()
        if size < 1e-12:
            break
        vs.append((v * (1 / size)).done())

        def weight(at: np.ndarray, first: bool = not k) -> np.ndarray:
            return np.ones(g) if first else ((differences(at) ** 2).sum(0) + 1e-6) ** -0.25

        def smooth(d: np.ndarray, at: np.ndarray, part: np.ndarray) -> np.ndarray:
            w = weight(at)
            apply, back = lambda y: w * differences(y), lambda y: differences_back(w * y)
            z = inner_lsqr(apply, back, inner_lsqr(back, apply, d - part * d.sum()))
            return z - (part * z).sum()

        def factor(at: np.ndarray, *basis: np.ndarray) -> np.ndarray:
            w, t = weight(at), len(basis)
            r = np.linalg.qr(np.stack([(w * differences(z)).ravel() for z in basis], 1), mode="r")
            return np.pad(r.ravel(), (0, -(t * t) % g[0]))

        zs.append(regular.whole(vs[-1], g, smooth, x, share).done())
        u = a.forward(zs[-1]).done()
        for j, q in enumerate(us):
            m[j, k] = u.dot(q)
            u = u.plus(-m[j, k], q).done()
        m[k + 1, k] = u.norm()
        t = k + 1
        r = regular.whole(x, g, factor, *zs).array().ravel()[: t * t].reshape(t, t)
        rhs = np.eye(2 * t + 1, 1)[:, 0] * beta
        y = np.linalg.lstsq(np.vstack([m[: t + 1, :t], damping * r]), rhs, rcond=None)[0]
        x = (constant + combination(y, zs)).done()
        history.append(float(np.linalg.norm(rhs[: t + 1] - m[: t + 1, :t] @ y)))
        if m[k + 1, k] < 1e-10:
            break
        us.append((u * (1 / m[k + 1, k])).done())
    return Result(x, history or [beta])


def fista(b: Field, a: Projector, iterations: int, hyper: float = 2e8, tv_weight: float = 0.1, tv_steps: int = 20, p: float = 1.0, q: float = 1.0, fast: bool = True) -> Result:
    """Proximal gradient with step 2 / hyper and a denoising step; ``fast`` adds momentum t = (p + sqrt(q + 4t²)) / 2."""
    out = Result(zeros(a))
    x, last, t = out.x, out.x, 1.0
    for _ in range(iterations):
        y = x.plus(2 / hyper, a.adjoint(b - a.forward(x), "matched")).done()
        now = regular.im3d_denoise(y, a.g.n_voxel, 1 / (2 * tv_weight / hyper), tv_steps).done() if tv_steps else y
        if fast:
            step = (p + np.sqrt(q + 4 * t * t)) / 2
            x, t = now.plus((t - 1) / step, now - last).done(), step
        else:
            x = now
        last = now
        out.x = now
        out.history.append((b - a.forward(now)).norm())
    return out


def ista(b: Field, a: Projector, iterations: int, **kw) -> Result:
    return fista(b, a, iterations, fast=False, **kw)


def osem(b: Field, a: Projector, iterations: int, blocksize: int = 20, x: Field | None = None) -> Result:
    """Block by block x *= A_j'(b_j / A_j x) / A_j' 1; from 1."""
    parts = blocks(a, blocksize)
    subs = [a.only(p) for p in parts]
    norms = [s.adjoint(s.ones(False)).inverse(1e-12).done() for s in subs]
    out = Result(x or a.ones(True).done())
    for _ in range(iterations):
        for part, s, n in zip(parts, subs, norms, strict=True):
            out.x = (out.x * s.adjoint(b.rows(part).over(s.forward(out.x))) * n).done()
        out.history.append((b - a.forward(out.x)).norm())
    return out


def mlem(b: Field, a: Projector, iterations: int, x: Field | None = None) -> Result:
    return osem(b, a, iterations, 1 << 30, x)


def enlarged(x: Field, shape: tuple[int, ...], to: tuple[int, ...]) -> Field:
    """A volume on a finer grid, each voxel that of the coarse one at its place; slice by slice."""
    from pyspark.sql import functions as F

    (_, cy, cx), (nz, ny, nx) = shape, to
    fine = a_range(x, nz).select("k", F.least(F.floor(F.col("k") * shape[0] / nz), F.lit(shape[0] - 1)).cast("int").alias("from_"))
    at = F.transform(F.sequence(F.lit(0), F.lit(ny * nx - 1)), lambda i: F.least(F.floor(F.floor(i / nx) * cy / ny), F.lit(cy - 1)) * cx + F.least(F.floor(i % nx * cx / nx), F.lit(cx - 1)))
    rows = fine.join(x.df.withColumnRenamed("k", "from_"), "from_")
    return Field(rows.select("k", F.transform(at, lambda i: F.get("data", i.cast("int"))).alias("data"))).done()


def a_range(x: Field, n: int):
    from pyspark.sql import functions as F

    return x.df.sparkSession.range(n).select(F.col("id").cast("int").alias("k"))


def multigrid_start(b: Field, a: Projector, levels: int = 2, iterations: int = 2) -> Field:
    """A first volume from coarse grids: SIRT on a grid of 1/2^levels, then each finer one from the one before."""
    g, x = a.g, None
    for level in range(levels, -1, -1):
        n = tuple(max(1, k >> level) for k in g.n_voxel)
        here = Projector(Geometry(**{**g.__dict__, "n_voxel": n}), a.views, a.kind, a.slab_bytes, a.rows)
        start = None if x is None else enlarged(x, last, n)
        if level:
            x, last = sirt(b, here, iterations, x=start).x, n
    return start if start is not None else zeros(a)


ALGORITHMS = {
    f.__name__: f
    for f in (fdk, fbp, sart, sirt, os_sart, os_sart_tv, asd_pocs, piccs, pcsd, cgls, lsqr, hybrid_lsqr, lsmr, irn_tv_cgls, ab_gmres, ba_gmres, hybrid_flsqr_tv, fista, ista, osem, mlem)
}
__all__ = [*ALGORITHMS, "ALGORITHMS", "Result", "multigrid_start", "blocks", "union"]
