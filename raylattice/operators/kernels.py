"""Numpy kernels that list, for one view, which cells meet which pixels with which weight.

Every projector is such a list (pixel, cell, weight), so that one pair of operators applies any of them and its exact
adjoint: ``siddon`` and ``interpolated`` weigh cells by their path in a pixel's ray, ``fdk`` and ``matched`` weigh
pixels by where a cell falls on the detector.
"""

from __future__ import annotations

import math

import numpy as np

from raylattice.geometry import Geometry, rays, rotation, view_rotation

#: Ray-plane crossings handled at once.
AT_ONCE = 2_000_000

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def siddon(g: Geometry, v: dict, lo: int = 0, hi: int | None = None) -> Entries:
    """Exact lengths of each ray in each voxel, in mm: all crossings with the planes, in order along the ray."""
    start, end = rays(g, v)
    hi = g.n_voxel[0] if hi is None else hi
    pitch, counts = np.array(g.d_voxel[::-1]), np.array([*g.n_voxel[:0:-1], hi - lo])
    base = -np.array(g.s_voxel[::-1]) / 2 + np.array([0, 0, lo * pitch[2]])
    top = base + counts * pitch
    nx, ny = counts[:2]
    out: list[Entries] = []
    step = max(1, AT_ONCE // int(counts.sum() + 3))
    for a in range(0, len(start), step):
        s, d = start[a : a + step], end[a : a + step] - start[a : a + step]
        d = np.where(np.abs(d) < 1e-9, 1e-9, d)
        near, far = (base - s) / d, (top - s) / d
        enter = np.maximum(np.minimum(near, far).max(1), 0.0)
        leave = np.minimum(np.maximum(near, far).min(1), 1.0)
        hit = np.flatnonzero(enter < leave - 1e-12)
        if not len(hit):
            continue
        s, d, enter, leave = s[hit], d[hit], enter[hit, None], leave[hit, None]
        at = np.concatenate([(np.arange(n + 1) * p + b - s[:, k, None]) / d[:, k, None] for k, (n, p, b) in enumerate(zip(counts, pitch, base, strict=True))], 1)
        at = np.sort(np.clip(at, enter, leave), 1)
        length = np.diff(at, axis=1)
        ray, seg = np.nonzero(length > 1e-12)
        mid = (at[ray, seg] + at[ray, seg + 1]) / 2
        cell = np.floor((s[ray] + mid[:, None] * d[ray] - base) / pitch).astype(int)
        cell = np.clip(cell, 0, counts - 1)
        out.append((a + hit[ray], (cell[:, 2] * ny + cell[:, 1]) * nx + cell[:, 0], length[ray, seg] * np.linalg.norm(d, axis=1)[ray]))
    return joined(out)


def joined(parts: list[Entries]) -> Entries:
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def spread(at: np.ndarray, counts: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(flat index or -1, weight) of the corners around points given in cells (rows, dimension slow to fast)."""
    low = np.floor(at).astype(int)
    part = at - low
    out = []
    for corner in np.ndindex(*(2,) * at.shape[1]):
        c = low + np.array(corner)
        w = np.prod(np.where(np.array(corner) == 1, part, 1 - part), axis=1)
        inside = ((c >= 0) & (c < np.array(counts))).all(1)
        out.append((np.where(inside, np.ravel_multi_index(np.clip(c, 0, np.array(counts) - 1).T, counts), -1), w))
    return out


def interpolated(g: Geometry, v: dict, lo: int = 0, hi: int | None = None) -> Entries:
    """Trilinear samples along each ray, ``accuracy`` voxels apart; outside the volume is 0."""
    start, end = rays(g, v)
    hi = g.n_voxel[0] if hi is None else hi
    size = np.array(g.s_voxel[::-1])
    pitch = np.array(g.d_voxel[::-1])
    out: list[Entries] = []
    reach = float(np.linalg.norm(size)) + float(pitch.max())
    step = g.accuracy * float(pitch.min())
    n = math.ceil(reach / step)
    for a in range(0, len(start), max(1, AT_ONCE // (8 * n))):
        s = start[a : a + max(1, AT_ONCE // (8 * n))]
        d = end[a : a + len(s)] - s
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        near = -(s * d).sum(1) - reach / 2  # centred on the point nearest to the volume's centre
        at = s[:, None] + (near[:, None] + (np.arange(n) + 0.5) * step)[..., None] * d[:, None]
        index = ((at + size / 2) / pitch - 0.5)[..., ::-1].reshape(-1, 3)
        ray = np.repeat(np.arange(len(s)), n)
        index[:, 0] -= lo
        there = np.flatnonzero((index[:, 0] > -1) & (index[:, 0] < hi - lo))
        ray, index = ray[there], index[there]
        for cell, w in spread(index, (hi - lo, *g.n_voxel[1:])):
            ok = (cell >= 0) & (w > 0)
            out.append((a + ray[ok], cell[ok], w[ok] * step))
    return joined(out)


def on_detector(g: Geometry, v: dict, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For points (x, y, z) of the volume: themselves in the view's frame, where their rays hit the detector, and that
    place in pixels (v, u)."""
    p = p + [v["off_x"], v["off_y"], v["off_z"]]
    p += v["cor"] * np.array([math.sin(v["alpha"]), -math.cos(v["alpha"]), 0.0])
    q = p @ view_rotation(v)  # the view's rotation undone
    turn = rotation("z", v["yaw"]) @ rotation("y", v["pitch"]) @ rotation("x", v["roll"])
    centre = np.array([v["dso"] - v["dsd"], v["off_u"], v["off_v"]])
    source = np.array([v["dso"], 0.0, 0.0])
    normal = turn[:, 0]
    if g.mode == "parallel":
        hit = q - np.outer((q - centre) @ normal / normal[0], [1.0, 0, 0])
    else:
        d = q - source
        hit = source + d * (((centre - source) @ normal) / (d @ normal))[:, None]
    flat = (hit - centre) @ turn
    at = np.stack([flat[:, k] / pitch + (n - 1) / 2 for k, pitch, n in ((2, g.d_detector[0], g.n_detector[0]), (1, g.d_detector[1], g.n_detector[1]))], 1)
    return q, hit, at


def rows_of(g: Geometry, v: dict, lo: int, hi: int) -> tuple[int, int]:
    """The detector rows [first, last) that the slices [lo, hi) of the volume, and a voxel around them, can meet: a box's
    shadow is spanned by those of its corners. All rows if the source isn't clear of the box."""
    half = np.array(g.s_voxel[::-1]) / 2 + np.array(g.d_voxel[::-1])
    z = [lo * g.d_voxel[0] - g.s_voxel[0] / 2 - g.d_voxel[0], hi * g.d_voxel[0] - g.s_voxel[0] / 2 + g.d_voxel[0]]
    corners = np.array([[x, y, k] for x in (-half[0], half[0]) for y in (-half[1], half[1]) for k in z])
    q, _, at = on_detector(g, v, corners)
    if g.mode == "cone" and q[:, 0].max() >= v["dso"] - 1e-6 or not np.isfinite(at).all() or abs(v["yaw"]) > 1 or abs(v["pitch"]) > 1:
        return 0, g.n_detector[0]
    return int(np.clip(np.floor(at[:, 0].min()) - 1, 0, g.n_detector[0])), int(np.clip(np.ceil(at[:, 0].max()) + 2, 0, g.n_detector[0]))


def voxel_driven(g: Geometry, v: dict, weight: str, lo: int = 0, hi: int | None = None) -> Entries:
    """Where each voxel's centre falls on the detector, bilinear over four pixels.

    ``fdk`` weighs by (dso / distance from the source along the axis)², ``matched`` by L³ / (dsd l²) with L and l the
    distances of the pixel and the voxel from the source, times the voxel's volume over the pixel's area. Parallel
    beams weigh by 1.
    """
    hi = g.n_voxel[0] if hi is None else hi
    z, y, x = ((np.arange(n) - (n - 1) / 2) * d for n, d in zip(g.n_voxel, g.d_voxel, strict=True))
    zz, yy, xx = np.meshgrid(z[lo:hi], y, x, indexing="ij")
    q, hit, at = on_detector(g, v, np.stack([xx.ravel(), yy.ravel(), zz.ravel()], 1))
    source = np.array([v["dso"], 0.0, 0.0])
    w = np.ones(len(q))
    if g.mode == "cone" and weight == "fdk":
        w = (v["dso"] / (v["dso"] - q[:, 0])) ** 2
    elif g.mode == "cone":
        far, close = np.linalg.norm(hit - source, axis=1), np.linalg.norm(q - source, axis=1)
        w = far**3 / (v["dsd"] * close**2) * np.prod(g.d_voxel) / np.prod(g.d_detector)
    cells = np.arange(len(q))
    out = []
    for pixel, share in spread(at, g.n_detector):
        ok = (pixel >= 0) & (share > 0)
        out.append((pixel[ok], cells[ok], share[ok] * w[ok]))
    return joined(out)


def entries(g: Geometry, v: dict, kind: str, lo: int = 0, hi: int | None = None) -> Entries:
    """(pixel, cell, weight) of one view and the slices [lo, hi) of the volume, whose cells are numbered from 0."""
    if kind == "siddon":
        return siddon(g, v, lo, hi)
    if kind == "interpolated":
        return interpolated(g, v, lo, hi)
    if kind in ("fdk", "matched"):
        return voxel_driven(g, v, kind, lo, hi)
    raise ValueError(f"unknown projector {kind!r}")
