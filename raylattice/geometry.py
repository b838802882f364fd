"""Scan geometry: validated settings, the views of a scan, and where source, pixels and voxels lie for a view."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEW = "proj_idx bigint, alpha double, theta double, psi double, dso double, dsd double, off_z double, off_y double, off_x double, off_v double, off_u double, yaw double, pitch double, roll double, cor double"
VIEW_FIELDS = [c.split()[0] for c in VIEW.split(", ")]


@dataclass(frozen=True)
class Geometry:
    """A scan's settings. Arrays are ordered Z, Y, X and V, U; lengths in mm. Unknown settings raise TypeError."""

    n_voxel: tuple[int, int, int]
    s_voxel: tuple[float, float, float]
    n_detector: tuple[int, int]
    d_detector: tuple[float, float]
    dso: float
    dsd: float
    mode: str = "cone"
    accuracy: float = 0.5
    off_origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    off_detector: tuple[float, float] = (0.0, 0.0)
    rot_detector: tuple[float, float, float] = (0.0, 0.0, 0.0)
    cor: float = 0.0

    def __post_init__(self) -> None:
        if self.mode not in ("cone", "parallel"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if len(self.n_voxel) != 3 or len(self.s_voxel) != 3 or len(self.n_detector) != 2 or len(self.d_detector) != 2:
            raise ValueError("voxel settings need three entries (Z, Y, X), detector settings two (V, U)")
        if min(*self.n_voxel, *self.n_detector) < 1 or min(*self.s_voxel, *self.d_detector) <= 0:
            raise ValueError("counts and sizes must be positive")
        if self.dsd < self.dso:
            raise ValueError("the detector lies between source and axis")

    @property
    def d_voxel(self) -> tuple[float, ...]:
        return tuple(s / n for s, n in zip(self.s_voxel, self.n_voxel, strict=True))

    @property
    def s_detector(self) -> tuple[float, ...]:
        return tuple(d * n for d, n in zip(self.d_detector, self.n_detector, strict=True))

    def with_sizes(self, **given: tuple) -> Geometry:
        """A copy, after checking that given counts, pitches and sizes agree to a millionth."""
        for n, d, s in (("n_voxel", "d_voxel", "s_voxel"), ("n_detector", "d_detector", "s_detector")):
            have = [given.get(k, getattr(self, k)) for k in (n, d, s)]
            if {n, d, s} & given.keys() and any(abs(a * b - c) >= 1e-6 for a, b, c in zip(*have, strict=True)):
                raise ValueError(f"{n} times {d} isn't {s}")
        return replace(self, **{k: v for k, v in given.items() if k not in ("d_voxel", "s_detector")})


def cone(n: int = 64, detector: int = 128) -> Geometry:
    """A cubic volume of 256 mm seen by a square detector 1536 mm from the source."""
    return Geometry((n,) * 3, (256.0,) * 3, (detector,) * 2, (409.6 / detector,) * 2, 1000.0, 1536.0)


def fan(n: int = 256, detector: int = 512) -> Geometry:
    """One slice and one detector row."""
    return Geometry((1, n, n), (1.0, 256.0, 256.0), (1, detector), (1.0, 409.6 / detector), 1000.0, 1536.0)


def parallel(n_voxel: tuple[int, int, int]) -> Geometry:
    """Unit voxels and pixels; the detector sees the whole volume."""
    n = (n_voxel[0], max(n_voxel[1:]))
    return Geometry(n_voxel, tuple(float(k) for k in n_voxel), n, (1.0, 1.0), float(n_voxel[0]), 2.0 * n_voxel[0], "parallel")


def views(spark: SparkSession, g: Geometry, angles: list, **varying: list) -> DataFrame:
    """One row per view. ``angles`` has alphas or (alpha, theta, psi) rows; any other view setting (dso, dsd,
    off_z, ... cor) may vary by a list of one value per view. Raises ValueError for other names, lengths and NaN."""
    if unknown := set(varying) - set(VIEW_FIELDS[4:]):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    if any(len(v) != len(angles) for v in varying.values()):
        raise ValueError("a varying setting needs one value per view")
    rows = []
    for i, a in enumerate(angles):
        a = (float(a), 0.0, 0.0) if np.ndim(a) == 0 else tuple(float(x) for x in a)
        row = dict(zip(VIEW_FIELDS, (i, *a, g.dso, g.dsd, *g.off_origin, *g.off_detector, *g.rot_detector, g.cor), strict=True))
        row |= {k: float(v[i]) for k, v in varying.items()}
        if any(x != x for x in row.values()):
            raise ValueError(f"view {i} has a NaN")
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, VIEW)


def resting_detector(views: DataFrame, geometry: Geometry, alpha: Column, dso: Column) -> DataFrame:
    """``views`` turned by ``alpha`` with the source ``dso`` from the axis, while the detector stays where it is at
    alpha 0: in the view's frame it is moved and turned back."""
    reach = geometry.dsd - geometry.dso
    views = views.withColumns({"a_": alpha, "s_": dso})
    return views.withColumns({
        "alpha": F.col("a_"), "dso": F.col("s_"), "dsd": F.col("s_") + reach * F.cos("a_"),
        "off_u": F.col("off_u") + reach * F.sin("a_"), "yaw": F.col("yaw") - F.col("a_"),
    }).drop("a_", "s_")


def static_detector(views: DataFrame, geometry: Geometry) -> DataFrame:
    """Tomosynthesis: the tube swings by alpha about the axis, the detector rests."""
    return resting_detector(views, geometry, F.col("alpha"), F.col("dso"))


def linear_source(views: DataFrame, geometry: Geometry, position: str = "s_pos") -> DataFrame:
    """A source moving along a line parallel to a resting detector: column ``position`` gives its place in mm."""
    s = F.col(position)
    return resting_detector(views, geometry, F.atan2(s, F.lit(geometry.dso)), F.sqrt(s * s + geometry.dso**2)).drop(position)


def rotation(axis: str, angle: float) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    return {"z": np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]), "y": np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]), "x": np.array([[1, 0, 0], [0, c, -s], [0, s, c]])}[axis]


def view_rotation(v: dict) -> np.ndarray:
    return rotation("z", v["alpha"]) @ rotation("y", v["theta"]) @ rotation("z", v["psi"])


def rays(g: Geometry, v: dict) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (x, y, z in mm about the volume's centre) of each pixel's ray, v slow and u fast.

    The source is at (dso, 0, 0), the detector at x = dso - dsd; pixels are turned by roll, pitch and yaw about the
    detector's centre, shifted by its offset, and turned with the source by the view's angles.
    """
    nv, nu = g.n_detector
    dv, du = g.d_detector
    pv, pu = np.meshgrid((np.arange(nv) - (nv - 1) / 2) * dv, (np.arange(nu) - (nu - 1) / 2) * du, indexing="ij")
    p = np.stack([np.zeros(nv * nu), pu.ravel(), pv.ravel()], 1)
    p = p @ (rotation("z", v["yaw"]) @ rotation("y", v["pitch"]) @ rotation("x", v["roll"])).T
    p += [v["dso"] - v["dsd"], v["off_u"], v["off_v"]]
    s = np.tile([v["dso"], 0.0, 0.0], (len(p), 1))
    if g.mode == "parallel":
        s[:, 1:] = p[:, 1:]
    turn = view_rotation(v)
    shift = np.array([v["off_x"], v["off_y"], v["off_z"]]) + v["cor"] * np.array([math.sin(v["alpha"]), -math.cos(v["alpha"]), 0.0])
    return s @ turn.T - shift, p @ turn.T - shift


def euler_from_vectors(normal: np.ndarray, up: np.ndarray) -> tuple[float, float, float]:
    """(yaw, pitch, roll) that turn the resting detector (normal x, up z) to the given normal and up vectors."""
    x = np.asarray(normal, float) / np.linalg.norm(normal)
    z = np.asarray(up, float) - x * np.dot(up, x)
    z /= np.linalg.norm(z)
    r = np.stack([x, np.cross(z, x), z], 1)
    pitch = math.asin(-np.clip(r[2, 0], -1, 1))
    return math.atan2(r[1, 0], r[0, 0]), pitch, math.atan2(r[2, 1], r[2, 2])


def foot_on_line(point: np.ndarray, start: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """The point of the line through ``start`` along ``direction`` that is nearest to ``point``."""
    p, s, d = (np.asarray(x, float) for x in (point, start, direction))
    if not d.any():
        raise ValueError("a line needs a direction")
    return s + d * (np.dot(p - s, d) / np.dot(d, d))


def rotation_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest rotation that takes direction a to direction b."""
    a, b = np.asarray(a, float) / np.linalg.norm(a), np.asarray(b, float) / np.linalg.norm(b)
    k, c = np.cross(a, b), float(np.dot(a, b))
    if c < -1 + 1e-12:
        p = np.cross(a, [1.0, 0, 0] if abs(a[0]) < 0.9 else [0, 1.0, 0])
        p /= np.linalg.norm(p)
        return 2 * np.outer(p, p) - np.eye(3)
    m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + m + m @ m / (1 + c)


def free_motion(spark: SparkSession, g: Geometry, source: np.ndarray, detector: np.ndarray, normal: np.ndarray | None = None, up: np.ndarray | None = None) -> DataFrame:
    """Views of a source and a detector that both move freely (positions in mm about the resting object, one row
    each): alpha follows the source, the detector's place and turn are told against the source's frame."""
    rows: dict[str, list] = {k: [] for k in ("dso", "dsd", "off_v", "off_u", "yaw", "pitch", "roll", "off_z")}
    angles = []
    for i, (s, d) in enumerate(zip(source, detector, strict=True)):
        a = math.atan2(s[1], s[0])
        back = rotation("z", -a)
        ls, ld = back @ s, back @ d
        n = back @ (normal[i] if normal is not None else s - d)
        u = back @ (up[i] if up is not None else np.array([0.0, 0, 1]))
        yaw, pitch, roll = euler_from_vectors(n, u)
        angles.append(a)
        for k, x in zip(rows, (ls[0], ls[0] - ld[0], ld[2] - ls[2], ld[1], yaw, pitch, roll, -ls[2]), strict=True):
            rows[k].append(x)
    return views(spark, g, angles, **rows)


def trajectory_centre(points: DataFrame) -> list[float]:
    """(x, y, z) nearest in the mean square to the lines through (px, py, pz) along unit (dx, dy, dz): normal
    equations from one aggregate, solved on the driver."""
    d, p = ("dx", "dy", "dz"), ("px", "py", "pz")
    m = {(i, j): (F.lit(1.0) if i == j else F.lit(0.0)) - F.col(d[i]) * F.col(d[j]) for i in range(3) for j in range(3)}
    row = points.agg(*[F.sum(m[i, j]).alias(f"a{i}{j}") for i, j in m], *[F.sum(sum((m[i, j] * F.col(p[j]) for j in (1, 2)), m[i, 0] * F.col(p[0]))).alias(f"b{i}") for i in range(3)]).first()
    a = np.array([[row[f"a{i}{j}"] for j in range(3)] for i in range(3)], float)
    return [float(x) for x in np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(3)], float), rcond=None)[0]]
