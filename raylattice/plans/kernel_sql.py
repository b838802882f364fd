"""SQL twins of the projector and reconstruction queries.

The system matrix is stated without a kernel's tricks: every ray is cut with the box of every voxel, and every voxel's
centre is thrown onto the detector of every view. The algorithms are then chains of joins and sums over it.
"""

from __future__ import annotations

from raylattice.plans.derived import GRID_SQL, NX, NY, NZ, volume_sql

AREA = NX * NY

#: The cone scan of the queries: 12 views, 10 by 16 pixels of 6 mm, voxels of 4 mm, source at 500 and detector at -250 mm.
BASE = f"""WITH {GRID_SQL}, {volume_sql()},
vox AS MATERIALIZED (SELECT CAST(z * {AREA} + y * {NX} + x AS INT) AS c, 4e0 * x - 22 AS lx, 4e0 * y - 22 AS ly, 4e0 * z - 14 AS lz FROM grid),
x0 AS MATERIALIZED (SELECT CAST(z * {AREA} + y * {NX} + x AS INT) AS c, value / 1e9 AS v FROM vol),
turns AS (SELECT CAST(p AS INT) AS p, 2 * pi() * p / 12 AS a FROM range(12) t(p)),
rays AS MATERIALIZED (SELECT p, CAST(r AS INT) AS ray, 500 * cos(a) AS sx, 500 * sin(a) AS sy, -750 * cos(a) - pu * sin(a) AS dx, -750 * sin(a) + pu * cos(a) AS dy, pv AS dz
  FROM turns, (SELECT r, 6 * (r // 16 - 4.5e0) AS pv, 6 * (r % 16 - 7.5e0) AS pu FROM range(160) t(r))),
cuts AS (SELECT p, ray, c, sqrt(dx * dx + dy * dy + dz * dz) AS d,
  greatest(0, least((lx - sx) / dx, (lx + 4 - sx) / dx), least((ly - sy) / dy, (ly + 4 - sy) / dy), least(lz / dz, (lz + 4) / dz)) AS a,
  least(1, greatest((lx - sx) / dx, (lx + 4 - sx) / dx), greatest((ly - sy) / dy, (ly + 4 - sy) / dy), greatest(lz / dz, (lz + 4) / dz)) AS b
  FROM (SELECT * REPLACE (CASE WHEN abs(dx) < 1e-9 THEN 1e-9 ELSE dx END AS dx, CASE WHEN abs(dy) < 1e-9 THEN 1e-9 ELSE dy END AS dy) FROM rays), vox),
siddon AS MATERIALIZED (SELECT p, ray, c, (b - a) * d AS w FROM cuts WHERE b - a > 1e-12),
seen AS (SELECT p, c, (lx + 2) * cos(a) + (ly + 2) * sin(a) AS qx, (ly + 2) * cos(a) - (lx + 2) * sin(a) AS qy, lz + 2 AS qz FROM turns, vox),
spots AS (SELECT p, c, qx, qy, qz, qy * 750 / (500 - qx) AS u, qz * 750 / (500 - qx) AS v FROM seen),
spread AS (SELECT *, u / 6 + 7.5e0 - floor(u / 6 + 7.5e0) AS fu, v / 6 + 4.5e0 - floor(v / 6 + 4.5e0) AS fv, CAST(floor(u / 6 + 7.5e0) AS INT) + i AS iu, CAST(floor(v / 6 + 4.5e0) AS INT) + j AS iv, i, j
  FROM spots, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j)),
corners AS MATERIALIZED (SELECT p, CAST(iv * 16 + iu AS INT) AS ray, c, (CASE i WHEN 1 THEN fu ELSE 1 - fu END) * (CASE j WHEN 1 THEN fv ELSE 1 - fv END) AS share, qx,
  power(sqrt(750 * 750 + u * u + v * v), 3) / (750 * (power(500 - qx, 2) + qy * qy + qz * qz)) * 64 / 36 AS matched FROM spread WHERE iu BETWEEN 0 AND 15 AND iv BETWEEN 0 AND 9),
fdk AS MATERIALIZED (SELECT p, ray, c, share * power(500 / (500 - qx), 2) AS w FROM corners),
matched AS MATERIALIZED (SELECT p, ray, c, share * matched AS w FROM corners)"""
IMAGES = "SELECT p AS k, ray AS i, round(v, 6) + 0.0 AS value FROM {}"
VOLUME = f"SELECT CAST(c // {AREA} AS INT) AS k, CAST(c % {AREA} AS INT) AS i, round(v, 6) + 0.0 AS value FROM {{}}"


class Chain:
    """Common table expressions one after the other; each step names its result."""

    def __init__(self) -> None:
        self.steps: list[str] = []

    def step(self, sql: str) -> str:
        name = f"s{len(self.steps)}"
        self.steps.append(f"{name} AS MATERIALIZED ({sql})")
        return name

    def forward(self, x: str, views: str = "true") -> str:
        return self.step(f"SELECT p, ray, coalesce(b, 0) AS v FROM rays LEFT JOIN (SELECT p, ray, sum(w * v) AS b FROM siddon JOIN {x} USING (c) WHERE {views} GROUP BY p, ray) USING (p, ray) WHERE {views}")

    def adjoint(self, b: str, kind: str = "siddon", views: str = "true") -> str:
        return self.step(f"SELECT c, coalesce(b, 0) AS v FROM vox LEFT JOIN (SELECT c, sum(w * v) AS b FROM {kind} JOIN {b} USING (p, ray) WHERE {views} GROUP BY c) USING (c)")

    def volume(self, expr: str, **of: str) -> str:
        return self.step(f"SELECT c, {expr} AS v FROM vox" + "".join(f" JOIN (SELECT c, v AS {k} FROM {t}) USING (c)" for k, t in of.items()))

    def images(self, expr: str, **of: str) -> str:
        return self.step(f"SELECT p, ray, {expr} AS v FROM rays" + "".join(f" JOIN (SELECT p, ray, v AS {k} FROM {t}) USING (p, ray)" for k, t in of.items()))

    def number(self, sql: str) -> str:
        return f"(SELECT v FROM {self.step(sql)})"

    def square(self, of: str) -> str:
        return self.number(f"SELECT sum(v * v) AS v FROM {of}")

    def sql(self, last: str, shape: str) -> str:
        return ", ".join([BASE, *self.steps]) + " " + shape.format(last)


def sampled(rays: int, width: int, pixel: float, parallel: bool) -> str:
    """Trilinear samples 2 mm apart along each ray, 37 about the point nearest to the volume's centre."""
    start = "500 * cos(a) - pu * sin(a) AS sx, 500 * sin(a) + pu * cos(a) AS sy, pv AS sz" if parallel else "500 * cos(a) AS sx, 500 * sin(a) AS sy, 0e0 AS sz"
    rows = rays // width
    return f"""{BASE.split("rays AS")[0]} way AS (SELECT p, CAST(r AS INT) AS ray, {start}, -250 * cos(a) - pu * sin(a) AS ex, -250 * sin(a) + pu * cos(a) AS ey, pv AS ez
  FROM turns, (SELECT r, {pixel} * (r // {width} - {(rows - 1) / 2}e0) AS pv, {pixel} * (r % {width} - {(width - 1) / 2}e0) AS pu FROM range({rays}) t(r))),
one AS (SELECT p, ray, sx, sy, sz, (ex - sx) / l AS dx, (ey - sy) / l AS dy, (ez - sz) / l AS dz FROM (SELECT *, sqrt(power(ex - sx, 2) + power(ey - sy, 2) + power(ez - sz, 2)) AS l FROM way)),
dots AS (SELECT p, ray, (sx + far * dx + 22) / 4 - 0.5e0 AS x, (sy + far * dy + 22) / 4 - 0.5e0 AS y, (sz + far * dz + 14) / 4 - 0.5e0 AS z
  FROM (SELECT *, -(sx * dx + sy * dy + sz * dz) - (sqrt(44 * 44 + 44 * 44 + 28 * 28) + 4) / 2 + (k + 0.5e0) * 2 AS far FROM one, range(37) t(k))),
near AS (SELECT p, ray, CAST((floor(z) + k) * {AREA} + (floor(y) + j) * {NX} + floor(x) + i AS INT) AS c,
  (CASE i WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE j WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE k WHEN 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) * 2 AS w
  FROM dots, range(2) ti(i), range(2) tj(j), range(2) tk(k) WHERE floor(z) + k BETWEEN 0 AND {NZ - 1} AND floor(y) + j BETWEEN 0 AND {NY - 1} AND floor(x) + i BETWEEN 0 AND {NX - 1})
SELECT p AS k, ray AS i, round(coalesce(v, 0), 6) + 0.0 AS value FROM way LEFT JOIN (SELECT p, ray, sum(w * v) AS v FROM near JOIN x0 USING (c) GROUP BY 1, 2) USING (p, ray)"""


def backprojected(kind: str) -> str:
    c = Chain()
    return c.sql(c.adjoint(c.forward("x0"), kind), VOLUME)


def projected() -> str:
    c = Chain()
    return c.sql(c.forward("x0"), IMAGES)


def filtered_backprojection() -> str:
    """The cosine weight, the ramp as a sum over the row, then the backprojection."""
    c = Chain()
    b = c.step(f"SELECT p, ray, v * 750 / sqrt(750 * 750 + power(6 * (ray % 16 - 7.5e0), 2) + power(6 * (ray // 16 - 4.5e0), 2)) AS v FROM {c.forward('x0')}")
    h = "CASE WHEN a.ray = b.ray THEN 0.25e0 WHEN (a.ray - b.ray) % 2 <> 0 THEN -1 / power(pi() * (a.ray - b.ray), 2) ELSE 0 END"
    f = c.step(f"SELECT a.p, a.ray, sum(2 * {h} * b.v) * 750 / 500 * 2 * pi() / 12 / 24 AS v FROM rays a JOIN {b} b ON a.p = b.p AND a.ray // 16 = b.ray // 16 GROUP BY 1, 2")
    return c.sql(c.adjoint(f, "fdk"), VOLUME)


def block_iteration(blocksize: int, iterations: int) -> str:
    """x += V A'W (b - A x), not below 0, block by block."""
    c = Chain()
    blocks = [f"p BETWEEN {k} AND {k + blocksize - 1}" for k in range(0, 12, blocksize)]
    b, ones = c.forward("x0"), c.step("SELECT p, ray, 1e0 AS v FROM rays")
    w = c.images("CASE WHEN a <= 2 THEN 0 ELSE 1 / a END", a=c.forward(c.step("SELECT c, 1e0 AS v FROM vox")))
    norms = [c.volume("CASE WHEN a <= 0 THEN 0 ELSE 1 / a END", a=c.adjoint(ones, "fdk", views)) for views in blocks]
    x = c.step("SELECT c, 0e0 AS v FROM vox")
    for _ in range(iterations):
        for views, n in zip(blocks, norms, strict=True):
            r = c.images("(b - a) * w", b=b, a=c.forward(x, views), w=w)
            x = c.volume("greatest(0, x + u * n)", x=x, u=c.adjoint(r, "fdk", views), n=n)
    return c.sql(x, VOLUME)


def multiplicative(blocksize: int, iterations: int) -> str:
    """x *= A'(b / A x) / A'1, block by block, from 1."""
    c = Chain()
    blocks = [f"p BETWEEN {k} AND {k + blocksize - 1}" for k in range(0, 12, blocksize)]
    b, ones = c.forward("x0"), c.step("SELECT p, ray, 1e0 AS v FROM rays")
    norms = [c.volume("CASE WHEN a <= 1e-12 THEN 0 ELSE 1 / a END", a=c.adjoint(ones, "siddon", views)) for views in blocks]
    x = c.step("SELECT c, 1e0 AS v FROM vox")
    for _ in range(iterations):
        for views, n in zip(blocks, norms, strict=True):
            q = c.images("CASE WHEN a = 0 THEN 0 ELSE b / a END", b=b, a=c.forward(x, views))
            x = c.volume("x * u * n", x=x, u=c.adjoint(q, "siddon", views), n=n)
    return c.sql(x, VOLUME)


def conjugate_gradients(iterations: int) -> str:
    """Least squares over the Krylov space of A'A, which LSQR spans as well."""
    c = Chain()
    r = c.forward("x0")
    p = c.adjoint(r)
    x, g = c.step("SELECT c, 0e0 AS v FROM vox"), c.square(p)
    for _ in range(iterations):
        q = c.forward(p)
        a = c.number(f"SELECT {g} / {c.square(q)} AS v")
        x, r = c.volume(f"x + {a} * p", x=x, p=p), c.images(f"r - {a} * q", r=r, q=q)
        s = c.adjoint(r)
        after = c.square(s)
        p, g = c.volume(f"s + {after} / {g} * p", s=s, p=p), after
    return c.sql(x, VOLUME)


def smallest(kind: str, damping: float = 0.0) -> str:
    """Two steps of the methods that make a residual smallest over a Krylov space, by its normal equations of two rows:
    ``AB`` |b - A A'y| with x = A'y, ``BA`` |A'b - (A'A + damping) x|."""
    c = Chain()
    b = c.forward("x0")
    g = c.adjoint(b)
    f = c.forward(g)
    second = c.adjoint(f)
    if kind == "AB":
        start, u, v = b, f, c.forward(second)
    else:
        once = c.adjoint(c.forward(second))
        start, u, v = g, c.volume(f"h + {damping} * g", h=second, g=g), c.volume(f"h + {damping} * g", h=once, g=second)
    keys = "p, ray" if kind == "AB" else "c"
    dot = c.step(f"SELECT sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(s * u) AS su, sum(s * v) AS sv FROM (SELECT {keys}, v AS s FROM {start}) JOIN (SELECT {keys}, v AS u FROM {u}) USING ({keys}) JOIN (SELECT {keys}, v FROM {v}) USING ({keys})")
    first, then = (f"(SELECT ({a}) / (uu * vv - uv * uv) FROM {dot})" for a in ("su * vv - sv * uv", "sv * uu - su * uv"))
    return c.sql(c.volume(f"{first} * g + {then} * h", g=g, h=second), VOLUME)


def of_embeddings(expr: str, from_: str = "e") -> str:
    """(proj_idx, i, value) of an expression over e(p, i, v): the embeddings plus 2 as images of 8 by 8."""
    return f"""WITH e AS (SELECT vec_id AS p, CAST(i AS INT) AS i, CAST(e AS DOUBLE) + 2 AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))
SELECT p AS proj_idx, i, round({expr}, 9) + 0.0 AS value FROM {from_}"""


RAMP = "(CASE WHEN {0} = 0 THEN 0.25e0 WHEN ({0}) % 2 <> 0 THEN -1 / power(pi() * ({0}), 2) ELSE 0 END)"
HANN = f"({RAMP.format('(a.i - b.i)')} + ({RAMP.format('(a.i - b.i - 1)')} + {RAMP.format('(a.i - b.i + 1)')}) / 2)"
ARC = "(1536 * atan((i % 8 - 3.5e0) * 40 / 1536) / 40 + 3.5e0)"

ORACLES = {
    "k01_siddon_cone": projected(),
    "k03_interpolated_cone": sampled(160, 16, 6, False),
    "k04_interpolated_parallel": sampled(98, 14, 4, True),
    "k05_backproject_fdk": backprojected("fdk"),
    "k06_backproject_matched": backprojected("matched"),
    "k08_adjoint": backprojected("siddon"),
    "k09_ramp_fft": of_embeddings(
        f"sum({HANN} * b.v) * 1536 / 1000 * 2 * pi() / 360 / 3.2e0", "(SELECT a.p, a.i, b.i AS j, b.v FROM e a JOIN e b ON a.p = b.p AND a.i // 8 = b.i // 8)"
    ).replace("a.i - b.i", "i - j").replace("* b.v", "* v") + " GROUP BY p, i",
    "k12_beam_hardening": of_embeddings("CASE WHEN v < 1 THEN 1.1e0 * v WHEN v < 2 THEN 1.1e0 + (v - 1) * 1.3e0 ELSE 2.4e0 + (v - 2) * 1.6e0 END"),
    "k14_rings": of_embeddings(
        "median(v)",
        "(SELECT a.p, a.i, b.v FROM e a CROSS JOIN range(-4, 5) t(o) JOIN e b ON a.p = b.p AND b.i = a.i // 8 * 8 + CASE WHEN a.i % 8 + o < 0 THEN -1 - a.i % 8 - o WHEN a.i % 8 + o > 7 THEN 15 - a.i % 8 - o ELSE a.i % 8 + o END)",
    ) + " GROUP BY p, i",
    "k15_flat_detector": of_embeddings(
        "lo.v + (pos - floor(pos)) * (hi.v - lo.v)",
        f"(SELECT p, i, {ARC} AS pos FROM e) JOIN (SELECT p, i AS li, v FROM e) lo USING (p) JOIN (SELECT p, i AS hi_, v FROM e) hi USING (p) WHERE li = i // 8 * 8 + CAST(floor(pos) AS INT) AND hi_ = i // 8 * 8 + least(7, CAST(floor(pos) AS INT) + 1)",
    ),
    "k19_spaced_readings": """WITH RECURSIVE one AS (SELECT DISTINCT scan_id, reading_id AS idx, CASE WHEN angle_unit = 'rad' THEN degrees(angle) ELSE angle END AS angle
  FROM projection WHERE scan_id IS NOT NULL AND angle IS NOT NULL AND NOT isnan(angle)),
v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY idx, angle) AS n FROM one),
walk AS (SELECT scan_id, idx, angle, n, angle AS kept, true AS keep FROM v WHERE n = 1 UNION ALL
  SELECT v.scan_id, v.idx, v.angle, v.n, CASE WHEN abs(v.angle - w.kept) > 2 THEN v.angle ELSE w.kept END, abs(v.angle - w.kept) > 2 FROM walk w JOIN v ON v.scan_id = w.scan_id AND v.n = w.n + 1)
SELECT scan_id, idx, angle FROM walk WHERE keep""",
    "r01_fdk": filtered_backprojection(),
    "r03_sart": block_iteration(1, 1),
    "r04_sirt": block_iteration(12, 2),
    "r05_os_sart": block_iteration(6, 2),
    "r11_cgls": conjugate_gradients(2),
    "r12_lsqr": conjugate_gradients(2),
    "r14_lsmr": smallest("BA", 1.0),
    "r16_ab_gmres": smallest("AB"),
    "r17_ba_gmres": smallest("BA"),
    "r20_mlem": multiplicative(12, 2),
    "r21_osem": multiplicative(6, 1),
}
assert NZ * AREA == 847
