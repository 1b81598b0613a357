"""The region queries as SQL for DuckDB, by other means than the Spark plans: flooding, pair and cell enumeration."""

from __future__ import annotations

_PIXELS = {
    "emb": """px AS (
  SELECT image_id, r, c FROM (SELECT vec_id // 64 AS image_id, vec_id % 64 AS r, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding) AS v FROM embeddings)
  WHERE CAST(v AS DOUBLE) > 0.05)""",
    "li": """px AS (
  SELECT DISTINCT CAST(ascii(l_returnflag) * 256 + ascii(l_linestatus) AS BIGINT) AS image_id, l_partkey % 256 AS r,
    CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 14 AS BIGINT) AS c FROM lineitem)""",
}
_RUNS = """runs AS (
  SELECT image_id, r * {width} + min(c) AS run_id, r, min(c) AS c0, max(c) AS c1
  FROM (SELECT *, c - row_number() OVER (PARTITION BY image_id, r ORDER BY c) AS g FROM px) GROUP BY image_id, r, g)"""
_REGIONS = """touch AS (
  SELECT a.image_id, a.run_id AS src, b.run_id AS dst FROM runs a JOIN runs b ON a.image_id = b.image_id AND a.r + 1 = b.r AND b.c0 <= a.c1 + 1 AND b.c1 >= a.c0 - 1),
either AS (SELECT image_id, src, dst FROM touch UNION ALL SELECT image_id, dst, src FROM touch),
reach AS (
  SELECT image_id, run_id, run_id AS label FROM runs
  UNION SELECT e.image_id, e.dst, x.label FROM reach x JOIN either e ON e.image_id = x.image_id AND e.src = x.run_id WHERE x.label < e.dst),
reg AS (SELECT r.*, l.region_id FROM runs r JOIN (SELECT image_id, run_id, min(label) AS region_id FROM reach GROUP BY 1, 2) l USING (image_id, run_id))"""
_CELLS = """cells AS (SELECT image_id, region_id, r, unnest(range(c0, c1 + 1)) AS c FROM reg),
box AS (SELECT image_id, region_id, min(r) AS r1, min(c) AS c1, max(r) AS r2, max(c) AS c2, count(*) AS area FROM cells GROUP BY 1, 2),
sums AS (
  SELECT image_id, region_id, b.r1, b.c1, b.r2, b.c2, b.area, sum(y)::HUGEINT AS s_r, sum(x)::HUGEINT AS s_c, sum(y * y)::HUGEINT AS s_rr, sum(x * x)::HUGEINT AS s_cc, sum(x * y)::HUGEINT AS s_rc,
    sum(y * y * y)::HUGEINT AS s_rrr, sum(y * y * x)::HUGEINT AS s_rrc, sum(y * x * x)::HUGEINT AS s_rcc, sum(x * x * x)::HUGEINT AS s_ccc
  FROM (SELECT k.image_id, k.region_id, k.r - b.r1 AS y, k.c - b.c1 AS x FROM cells k JOIN box b USING (image_id, region_id)) JOIN box b USING (image_id, region_id) GROUP BY ALL),
mom0 AS (
  SELECT *, r1 + s_r::DOUBLE / area AS row_, c1 + s_c::DOUBLE / area AS col_, (area * s_rr - s_r * s_r)::DOUBLE / area / area AS mu_rr,
    (area * s_cc - s_c * s_c)::DOUBLE / area / area AS mu_cc, (area * s_rc - s_r * s_c)::DOUBLE / area / area AS mu_rc FROM sums),
mom1 AS (SELECT *, sqrt((mu_rr - mu_cc) * (mu_rr - mu_cc) + 4 * mu_rc * mu_rc) AS root, mu_rr + mu_cc AS trace, -0.5 * atan2(2 * mu_rc, mu_cc - mu_rr) AS phi0 FROM mom0),
mom AS (
  SELECT *, (trace + root) / 2 AS ia, greatest(0.0, (trace - root) / 2) AS ib, sqrt(2 * (trace + root)) AS ra,
    CASE WHEN mu_rr * mu_cc - mu_rc * mu_rc <= 1e-12 * greatest(1.0, trace * trace) THEN 0.0 ELSE sqrt(greatest(0.0, 2 * (trace - root))) END AS rb,
    CASE WHEN phi0 <= -pi() / 2 THEN phi0 + pi() ELSE phi0 END AS phi FROM mom1),
ecc AS (
  SELECT *, CASE WHEN rb > 0 THEN ra / rb WHEN ra > 0 THEN 'Infinity'::DOUBLE END AS anisometry, pi() * ra * rb / area AS bulkiness,
    CASE WHEN rb > 0 THEN ra / rb * (pi() * ra * rb / area) - 1 END AS structure_factor FROM mom),
topo AS (
  SELECT image_id, region_id, n AS runs, n - coalesce(k, 0) AS euler, 1 - n + coalesce(k, 0) AS holes
  FROM (SELECT image_id, region_id, count(*) AS n FROM reg GROUP BY 1, 2) LEFT JOIN
    (SELECT g.image_id, g.region_id, count(*) AS k FROM touch t JOIN reg g ON g.image_id = t.image_id AND g.run_id = t.src GROUP BY 1, 2) USING (image_id, region_id)),
far0 AS (SELECT k.image_id, k.region_id, k.r, k.c, (m.area * (k.r - m.r1) - m.s_r) * (m.area * (k.r - m.r1) - m.s_r) + (m.area * (k.c - m.c1) - m.s_c) * (m.area * (k.c - m.c1) - m.s_c) AS d2 FROM cells k JOIN mom m USING (image_id, region_id)),
far AS (
  SELECT image_id, region_id, r AS far_r, c AS far_c, sqrt(d2::DOUBLE) / area AS max_distance
  FROM (SELECT *, row_number() OVER (PARTITION BY image_id, region_id ORDER BY d2 DESC, r, c) AS n FROM far0) JOIN box USING (image_id, region_id) WHERE n = 1)"""
_FILLED = """padded AS (SELECT image_id, region_id, r, unnest(range(c1 - 1, c2 + 2)) AS c, r1, c1 FROM (SELECT *, unnest(range(r1 - 1, r2 + 2)) AS r FROM box)),
free AS (SELECT p.* FROM padded p ANTI JOIN cells k USING (image_id, region_id, r, c)),
outside AS (
  SELECT image_id, region_id, r, c FROM free WHERE r = r1 - 1 AND c = c1 - 1
  UNION SELECT f.image_id, f.region_id, f.r, f.c FROM outside o JOIN free f ON f.image_id = o.image_id AND f.region_id = o.region_id AND abs(f.r - o.r) + abs(f.c - o.c) = 1),
full_ AS (SELECT image_id, region_id, r, c FROM padded p ANTI JOIN outside o USING (image_id, region_id, r, c)),
quads AS (
  SELECT image_id, region_id, r - i AS wr, c - j AS wc, sum(1 << CAST(2 * i + j AS INTEGER)) AS mask
  FROM full_, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(i, j) GROUP BY ALL),
cont AS (
  SELECT image_id, region_id, count(CASE WHEN mask IN (3, 12, 5, 10) THEN 1 END) + (count(CASE WHEN mask IN (7, 11, 13, 14) THEN 1 END) + 2 * count(CASE WHEN mask IN (6, 9) THEN 1 END)) * sqrt(2) AS contlength
  FROM quads GROUP BY 1, 2),
steps AS (
  SELECT image_id, region_id, wr, wc, CASE WHEN mask IN (6, 9) THEN 2 ELSE 1 END AS w, unnest(CASE mask WHEN 3 THEN [0, 1] WHEN 12 THEN [2, 3] WHEN 5 THEN [0, 2] WHEN 10 THEN [1, 3] WHEN 7 THEN [1, 2] WHEN 14 THEN [1, 2] WHEN 11 THEN [0, 3] WHEN 13 THEN [0, 3] WHEN 6 THEN [1, 2] WHEN 9 THEN [0, 3] END) AS p
  FROM quads WHERE mask NOT IN (1, 2, 4, 8, 15)),
dist AS (SELECT s.image_id, s.region_id, w, sqrt((wr + p // 2 - row_) * (wr + p // 2 - row_) + (wc + p % 2 - col_) * (wc + p % 2 - col_)) AS d FROM steps s JOIN mom m USING (image_id, region_id)),
mean AS (SELECT image_id, region_id, sum(d * w) / sum(w) AS distance FROM dist GROUP BY 1, 2),
spread AS (SELECT image_id, region_id, distance, sqrt(sum((d - distance) * (d - distance) * w) / sum(w)) AS sigma0 FROM dist JOIN mean USING (image_id, region_id) GROUP BY 1, 2, 3),
round_ AS (
  SELECT image_id, region_id, distance, sigma, CASE WHEN distance > 0 THEN 1 - sigma / distance END AS roundness, CASE WHEN sigma > 0 THEN 1.4111 * pow(distance / sigma, 0.4724) END AS sides
  FROM (SELECT *, CASE WHEN sigma0 <= 1e-9 * distance THEN 0.0 ELSE sigma0 END AS sigma FROM spread))"""
_HULL = """corner AS (
  SELECT image_id, region_id, r, unnest([min(c), max(c)]) AS c
  FROM (SELECT image_id, region_id, unnest([r, r, r + 1, r + 1]) AS r, unnest([c0, c1 + 1, c0, c1 + 1]) AS c FROM reg) GROUP BY 1, 2, 3),
pt AS (SELECT DISTINCT * FROM corner),
edge AS (
  SELECT p.image_id, p.region_id, p.r AS ar, p.c AS ac, q.r AS br, q.c AS bc FROM pt p JOIN pt q ON p.image_id = q.image_id AND p.region_id = q.region_id AND (p.r <> q.r OR p.c <> q.c)
  WHERE NOT EXISTS (
    SELECT 1 FROM pt s WHERE s.image_id = p.image_id AND s.region_id = p.region_id AND (
      (q.r - p.r) * (s.c - p.c) - (q.c - p.c) * (s.r - p.r) < 0 OR
      ((q.r - p.r) * (s.c - p.c) - (q.c - p.c) * (s.r - p.r) = 0 AND (s.r - p.r) * (s.r - q.r) + (s.c - p.c) * (s.c - q.c) > 0)))),
hull AS (SELECT image_id, region_id, abs(sum(ar * bc - ac * br)) / 2 AS hull_area FROM edge GROUP BY 1, 2),
span AS (
  SELECT e.image_id, e.region_id, br - ar AS dr, bc - ac AS dc, sqrt((br - ar) * (br - ar) + (bc - ac) * (bc - ac)) AS len,
    min(s.r * (br - ar) + s.c * (bc - ac)) AS u0, max(s.r * (br - ar) + s.c * (bc - ac)) AS u1, min(s.c * (br - ar) - s.r * (bc - ac)) AS v0, max(s.c * (br - ar) - s.r * (bc - ac)) AS v1
  FROM edge e JOIN pt s USING (image_id, region_id) GROUP BY e.image_id, e.region_id, ar, ac, br, bc),
side AS (SELECT *, (u1 - u0) / len AS e, (v1 - v0) / len AS f, (u1 + u0) / len / 2 AS u, (v1 + v0) / len / 2 AS v, atan2(-dr, dc) AS phi0 FROM span),
angle AS (SELECT *, CASE WHEN abs(e - f) <= 1e-9 THEN phi0 - pi() / 2 * ceil((phi0 - pi() / 4 - 1e-9) / (pi() / 2)) WHEN e > f THEN phi0 ELSE phi0 + pi() / 2 END AS phi1 FROM side),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, region_id ORDER BY round(e * f, 9), -round(greatest(e, f), 9), round(phi2, 9)) AS n
  FROM (SELECT *, CASE WHEN abs(e - f) <= 1e-9 THEN phi1 WHEN phi1 <= -pi() / 2 + 1e-9 THEN phi1 + pi() WHEN phi1 > pi() / 2 + 1e-9 THEN phi1 - pi() ELSE phi1 END AS phi2 FROM angle)),
rect AS (
  SELECT image_id, region_id, (u * dr - v * dc) / len - 0.5 AS rect2_row, (u * dc + v * dr) / len - 0.5 AS rect2_col, phi2 AS rect2_phi, greatest(e, f) / 2 AS rect2_long, least(e, f) / 2 AS rect2_short
  FROM ranked WHERE n = 1)"""

_DIAMETER = """diam AS (
  SELECT image_id, region_id, sqrt(d2) AS diameter, r1 AS diameter_r1, c1 AS diameter_c1, r2 AS diameter_r2, c2 AS diameter_c2 FROM (
    SELECT a.image_id, a.region_id, a.r AS r1, a.c AS c1, b.r AS r2, b.c AS c2, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d2,
      row_number() OVER (PARTITION BY a.image_id, a.region_id ORDER BY (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) DESC, a.r, a.c, b.r, b.c) AS n
    FROM (SELECT DISTINCT image_id, region_id, r, unnest([c0, c1]) AS c FROM reg) a JOIN (SELECT DISTINCT image_id, region_id, r, unnest([c0, c1]) AS c FROM reg) b
      USING (image_id, region_id) WHERE (a.r, a.c) <= (b.r, b.c)) WHERE n = 1)"""
_INNER = """incirc AS (
  SELECT image_id, region_id, r AS inner_row, c AS inner_col, sqrt(d2) - 0.5 AS inner_radius FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id, region_id ORDER BY d2 DESC, r, c) AS n FROM (
      SELECT k.image_id, k.region_id, k.r, k.c, min((k.r - f.r) * (k.r - f.r) + (k.c - f.c) * (k.c - f.c)) AS d2 FROM cells k JOIN free f USING (image_id, region_id) GROUP BY ALL)) WHERE n = 1)"""
_INNER_RECT = """inrect AS (
  SELECT image_id, region_id, r1 AS inner_r1, c1 AS inner_c1, r2 AS inner_r2, c2 AS inner_c2 FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id, region_id ORDER BY size DESC, r1, c1, r2, c2) AS n FROM (
      SELECT a.image_id, a.region_id, a.r AS r1, a.c AS c1, b.r AS r2, b.c AS c2, (b.r - a.r + 1) * (b.c - a.c + 1) AS size
      FROM cells a JOIN cells b ON a.image_id = b.image_id AND a.region_id = b.region_id AND a.r <= b.r AND a.c <= b.c
      JOIN cells k ON k.image_id = a.image_id AND k.region_id = a.region_id AND k.r BETWEEN a.r AND b.r AND k.c BETWEEN a.c AND b.c
      GROUP BY ALL HAVING count(*) = (b.r - a.r + 1) * (b.c - a.c + 1))) WHERE n = 1)"""
#: Every circle through two or three vertices of the hull; the smallest that holds all of them.
_CIRCLE = """vertex AS (SELECT DISTINCT image_id, region_id, ar AS r, ac AS c FROM edge),
through AS (
  SELECT a.image_id, a.region_id, (a.r + b.r) / 2.0 AS y, (a.c + b.c) / 2.0 AS x, ((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) / 4.0 AS q
  FROM vertex a JOIN vertex b ON a.image_id = b.image_id AND a.region_id = b.region_id AND (a.r, a.c) < (b.r, b.c)
  UNION ALL
  SELECT image_id, region_id, r + y, c + x, y * y + x * x FROM (
    SELECT image_id, region_id, r, c, (c2 * (r1 * r1 + c1 * c1) - c1 * (r2 * r2 + c2 * c2)) / (2.0 * (r1 * c2 - c1 * r2)) AS y, (r1 * (r2 * r2 + c2 * c2) - r2 * (r1 * r1 + c1 * c1)) / (2.0 * (r1 * c2 - c1 * r2)) AS x
    FROM (SELECT a.image_id, a.region_id, a.r, a.c, b.r - a.r AS r1, b.c - a.c AS c1, d.r - a.r AS r2, d.c - a.c AS c2
      FROM vertex a JOIN vertex b ON a.image_id = b.image_id AND a.region_id = b.region_id AND (a.r, a.c) < (b.r, b.c)
      JOIN vertex d ON a.image_id = d.image_id AND a.region_id = d.region_id AND (b.r, b.c) < (d.r, d.c)) WHERE r1 * c2 <> c1 * r2)),
circ AS (
  SELECT image_id, region_id, min_by(y, q) - 0.5 AS circle_row, min_by(x, q) - 0.5 AS circle_col, sqrt(min(q)) AS circle_radius FROM (
    SELECT t.image_id, t.region_id, y, x, q FROM through t JOIN vertex v USING (image_id, region_id) GROUP BY ALL HAVING max((v.r - y) * (v.r - y) + (v.c - x) * (v.c - x)) <= q + 1e-9) GROUP BY 1, 2)"""
_HU = """hu AS (
  SELECT image_id, region_id, e20 + e02 AS h1, (e20 - e02) * (e20 - e02) + 4 * e11 * e11 AS h2, u * u + v * v AS h3, p * p + q * q AS h4, u * p * (p * p - 3 * q * q) + v * q * (3 * p * p - q * q) AS h5,
    (e20 - e02) * (p * p - q * q) + 4 * e11 * p * q AS h6, v * p * (p * p - 3 * q * q) - u * q * (3 * p * p - q * q) AS h7 FROM (
    SELECT *, e30 + e12 AS p, e21 + e03 AS q, e30 - 3 * e12 AS u, 3 * e21 - e03 AS v FROM (
      SELECT image_id, region_id, m.mu_rr / m.area AS e20, m.mu_cc / m.area AS e02, m.mu_rc / m.area AS e11, sum(pow(k.r - row_, 3)) / pow(m.area, 2.5) AS e30, sum(pow(k.c - col_, 3)) / pow(m.area, 2.5) AS e03,
        sum(pow(k.r - row_, 2) * (k.c - col_)) / pow(m.area, 2.5) AS e21, sum((k.r - row_) * pow(k.c - col_, 2)) / pow(m.area, 2.5) AS e12
      FROM cells k JOIN mom m USING (image_id, region_id) GROUP BY image_id, region_id, m.mu_rr, m.mu_cc, m.mu_rc, m.area)))"""

#: The outer contour walked edge by edge: where each edge between a region's pixel and another leads, then round from above the first pixel.
_RING = """crack AS (
  SELECT k.image_id, k.region_id, k.r, k.c, s.side, s.lr, s.lc, s.dr, s.dc FROM cells k, (VALUES (0, -1, 0, 0, 1), (1, 0, 1, 1, 0), (2, 1, 0, 0, -1), (3, 0, -1, -1, 0)) AS s(side, lr, lc, dr, dc)
  WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE o.image_id = k.image_id AND o.region_id = k.region_id AND o.r = k.r + s.lr AND o.c = k.c + s.lc)),
lead_ AS (
  SELECT c.image_id, c.region_id, c.r, c.c, c.side, coalesce(l.r, a.r, c.r) AS nr, coalesce(l.c, a.c, c.c) AS nc,
    CASE WHEN l.r IS NOT NULL THEN (c.side + 3) % 4 WHEN a.r IS NOT NULL THEN c.side ELSE (c.side + 1) % 4 END AS nside, l.r IS NOT NULL OR a.r IS NOT NULL AS step
  FROM crack c LEFT JOIN cells l ON l.image_id = c.image_id AND l.region_id = c.region_id AND l.r = c.r + c.dr + c.lr AND l.c = c.c + c.dc + c.lc
    LEFT JOIN cells a ON a.image_id = c.image_id AND a.region_id = c.region_id AND a.r = c.r + c.dr AND a.c = c.c + c.dc),
ring AS (
  SELECT *, 0 AS n FROM lead_ WHERE side = 0 AND r * 64 + c = region_id
  UNION ALL SELECT t.*, g.n + 1 FROM ring g JOIN lead_ t ON t.image_id = g.image_id AND t.region_id = g.region_id AND t.r = g.nr AND t.c = g.nc AND t.side = g.nside
  WHERE NOT (t.side = 0 AND t.r * 64 + t.c = t.region_id))"""


def _r(*columns: str) -> str:
    """Columns rounded to six places, without negative zero; ``expression AS name`` or a name."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ")
        out.append(f"round({expression or name}, 6) + 0.0 AS {name}")
    return ", ".join(out)


def _sql(stages: list[str], body: str, raster: str = "emb", width: int = 64) -> str:
    parts = [_PIXELS[raster], _RUNS.format(width=width), *stages]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


_KEY = "image_id, region_id"
_BASE = [_REGIONS, _CELLS]
_IN = "anisometry BETWEEN 1.5 AND 'Infinity'::DOUBLE"
_ALL = f"""SELECT {_KEY}, m.area, e.anisometry, t.holes, t.euler, t.runs / sqrt(m.area) AS k_factor, m.area / h.hull_area AS convexity, o.roundness
FROM mom m JOIN ecc e USING ({_KEY}) JOIN topo t USING ({_KEY}) JOIN hull h USING ({_KEY}) LEFT JOIN round_ o USING ({_KEY})"""

_ORIENTATION = "CASE WHEN (far_c - col_) * cos(phi) - (far_r - row_) * sin(phi) < -1e-9 THEN CASE WHEN phi > 0 THEN phi - pi() ELSE phi + pi() END ELSE phi END"
_CIRCULARITY = "CASE WHEN max_distance > 0 THEN least(1.0, m.area / (pi() * max_distance * max_distance)) END"
#: Every feature of every region.
_WIDE = [*_BASE, _FILLED, _HULL, _DIAMETER, _INNER, _INNER_RECT, _CIRCLE, _HU]
_JOINED = "mom m " + " ".join(f"JOIN {t} USING ({_KEY})" for t in ("far", "cont", "hull", "rect", "diam", "circ", "incirc", "inrect", "hu", "topo")) + f" JOIN (SELECT {_KEY}, count(*) AS filled_area FROM full_ GROUP BY 1, 2) USING ({_KEY}) LEFT JOIN round_ o USING ({_KEY}) JOIN (SELECT {_KEY}, anisometry, bulkiness, structure_factor FROM ecc) USING ({_KEY})"
_VECTOR = f"""SELECT {_KEY}, m.area, filled_area - m.area AS area_holes, m.r1, m.c1, m.r2, m.c2, inner_row, inner_col, inner_r1, inner_c1, inner_r2, inner_c2, runs, euler, holes, CAST(1 AS BIGINT) AS components,
  (s_rr + 2 * m.r1 * s_r + m.r1 * m.r1 * m.area)::BIGINT AS m_rr_origin, (s_cc + 2 * m.c1 * s_c + m.c1 * m.c1 * m.area)::BIGINT AS m_cc_origin, (s_rc + m.r1 * s_c + m.c1 * s_r + m.r1 * m.c1 * m.area)::BIGINT AS m_rc_origin,
  {_r("row_ AS row", "col_ AS col", "contlength", "diameter", f"{_CIRCULARITY} AS circularity", "contlength * contlength / (4 * pi() * m.area) AS compactness", "m.area / hull_area AS convexity",
      "m.area / (4 * rect2_long * rect2_short) AS rectangularity", "distance", "sigma", "roundness", "sides", "ra", "rb", "phi", "anisometry", "bulkiness", "structure_factor", f"{_ORIENTATION} AS orientation",
      "rect2_row", "rect2_col", "rect2_phi", "rect2_long", "rect2_short", "circle_row", "circle_col", "circle_radius", "inner_radius", "rect2_long / rect2_short AS aspect_ratio",
      "m.area / (4 * rect2_long * rect2_short) AS fill_ratio", "inner_radius / circle_radius AS in_out_ratio", "mu_rr", "mu_cc", "mu_rc", "ia", "ib", *(f"h{i}" for i in range(1, 8)), *(f"h{i} AS hu_{i}" for i in range(1, 8)),
      "runs / sqrt(m.area) AS k_factor", "CASE WHEN diameter > 0 THEN contlength / diameter END AS contlength_by_diameter")}
FROM {_JOINED}"""
_PROFILE = [("coater", "area", 1.0, 50.0, False), ("coater", "convexity", 0.4, 1.0, True), ("roll_press", "anisometry", 1.0, 6.0, False), ("roll_press", "k_factor", 0.5, 3.0, True), ("slitter", "roundness", 0.2, 1.0, True)]
_CODES = [
    ("coater", "pinhole", "circularity BETWEEN 0.7 AND 1 AND area BETWEEN 1 AND 4"), ("coater", "uncoated", "area >= 60"), ("coater", "tear", "convexity BETWEEN 0 AND 0.6"),
    ("coater", "bubbles", "holes >= 1 AND euler <= 0"), ("roll_press", "wrinkle", "anisometry >= 3 AND orientation BETWEEN -1 AND 1"), ("roll_press", "crack", "anisometry >= 4"),
    ("roll_press", "pressed_in", "rectangularity BETWEEN 0.9 AND 1"), ("slitter", "burr", "roundness BETWEEN 0 AND 0.5 AND sides BETWEEN 0 AND 3"), ("slitter", "bad_cut", "contlength_by_diameter >= 2.5"),
]

SQL: dict[str, str] = {
    "q01_runs": _sql([], "SELECT * FROM runs"),
    "q02_links": _sql(_BASE[:1], f"SELECT {_KEY}, src, dst FROM touch JOIN (SELECT image_id, run_id AS src, region_id FROM reg) USING (image_id, src)"),
    "q03_regions": _sql(_BASE[:1], f"SELECT {_KEY}, run_id FROM reg"),
    "q04_area_center": _sql(_BASE, f"SELECT {_KEY}, area, {_r('row_ AS row', 'col_ AS col')} FROM mom"),
    "q05_bbox": _sql(_BASE, f"SELECT {_KEY}, r1, c1, r2, c2 FROM box"),
    "q06_moments": _sql(_BASE, f"SELECT {_KEY}, sum(r * r)::BIGINT AS m_rr_origin, sum(c * c)::BIGINT AS m_cc_origin, sum(r * c)::BIGINT AS m_rc_origin FROM cells GROUP BY 1, 2"),
    "q07_central": _sql(_BASE, f"SELECT {_KEY}, {_r('mu_rr', 'mu_cc', 'mu_rc')} FROM mom"),
    "q08_inertia": _sql(_BASE, f"SELECT {_KEY}, {_r('ia', 'ib')} FROM mom"),
    "q09_elliptic_axis": _sql(_BASE, f"SELECT {_KEY}, {_r('ra', 'rb', 'phi')} FROM mom"),
    "q10_eccentricity": _sql(_BASE, f"SELECT {_KEY}, {_r('anisometry', 'bulkiness', 'structure_factor')} FROM ecc"),
    "q11_orientation": _sql(_BASE, f"""SELECT {_KEY}, {_r("CASE WHEN (far_c - col_) * cos(phi) - (far_r - row_) * sin(phi) < -1e-9 THEN CASE WHEN phi > 0 THEN phi - pi() ELSE phi + pi() END ELSE phi END AS orientation")}, far_r, far_c FROM mom JOIN far USING ({_KEY})"""),
    "q12_euler_holes": _sql(_BASE, f"SELECT {_KEY}, euler, holes FROM topo"),
    "q12_image_topology": _sql(_BASE, "SELECT image_id, count(*) AS components, sum(euler)::BIGINT AS euler, (count(*) - sum(euler))::BIGINT AS holes FROM topo GROUP BY 1"),
    "q13_runlength": _sql(_BASE, f"SELECT {_KEY}, runs, {_r('runs / sqrt(area) AS k_factor')} FROM topo JOIN box USING ({_KEY})"),
    "q14_area_holes": _sql([*_BASE, _FILLED], f"SELECT {_KEY}, count(*) AS filled_area, count(*) - any_value(area) AS area_holes FROM full_ JOIN box USING ({_KEY}) GROUP BY 1, 2"),
    "q15_contlength": _sql([*_BASE, _FILLED], f"SELECT {_KEY}, {_r('contlength')} FROM cont"),
    "q16_compactness": _sql([*_BASE, _FILLED], f"SELECT {_KEY}, {_r('contlength * contlength / (4 * pi() * area) AS compactness')} FROM cont JOIN box USING ({_KEY})"),
    "q17_roundness": _sql([*_BASE, _FILLED], f"SELECT {_KEY}, {_r('distance', 'sigma', 'roundness', 'sides')} FROM round_"),
    "q18_circularity": _sql(_BASE, f"SELECT {_KEY}, {_r('max_distance', 'CASE WHEN max_distance > 0 THEN least(1.0, area / (pi() * max_distance * max_distance)) END AS circularity')} FROM far JOIN box USING ({_KEY})"),
    "q19_diameter": _sql([*_BASE[:1], _DIAMETER], f"SELECT {_KEY}, {_r('diameter')}, diameter_r1, diameter_c1, diameter_r2, diameter_c2 FROM diam"),
    "q20_convexity": _sql([*_BASE, _HULL], f"SELECT {_KEY}, {_r('hull_area', 'area / hull_area AS convexity')} FROM hull JOIN box USING ({_KEY})"),
    "q21_rect2": _sql([*_BASE, _HULL], f"SELECT {_KEY}, {_r('rect2_row', 'rect2_col', 'rect2_phi', 'rect2_long', 'rect2_short')} FROM rect"),
    "q22_rectangularity": _sql([*_BASE, _HULL], f"SELECT {_KEY}, {_r('area / (4 * rect2_long * rect2_short) AS rectangularity', 'rect2_long / rect2_short AS aspect_ratio', 'area / (4 * rect2_long * rect2_short) AS fill_ratio')} FROM rect JOIN box USING ({_KEY})"),
    "q23_inner_circle": _sql([*_BASE, _FILLED, _INNER], f"SELECT {_KEY}, inner_row, inner_col, {_r('inner_radius')} FROM incirc"),
    "q24_inner_rectangle": _sql([*_BASE, _INNER_RECT], "SELECT * FROM inrect"),
    "q25_smallest_circle": _sql([*_BASE, _HULL, _CIRCLE], f"SELECT {_KEY}, {_r('circle_row', 'circle_col', 'circle_radius')} FROM circ"),
    "q26_in_out_ratio": _sql([*_BASE, _FILLED, _HULL, _CIRCLE, _INNER], f"SELECT {_KEY}, {_r('inner_radius / circle_radius AS in_out_ratio')} FROM circ JOIN incirc USING ({_KEY})"),
    "q27_hu": _sql([*_BASE, _HU], f"SELECT {_KEY}, {_r(*(f'h{i}' for i in range(1, 8)))} FROM hu"),
    "q28_select_and": _sql(_BASE, f"SELECT {_KEY}, area, {_r('anisometry')}, holes FROM ecc JOIN topo USING ({_KEY}) WHERE area BETWEEN 10 AND 100 AND {_IN} AND holes >= 1"),
    "q29_select_or": _sql(_BASE, f"SELECT {_KEY}, area, {_r('anisometry')}, holes FROM ecc JOIN topo USING ({_KEY}) WHERE area BETWEEN 10 AND 100 OR coalesce({_IN}, false) OR holes >= 1"),
    "q30_scores": _sql([*_BASE, _FILLED, _HULL], f"""SELECT {_KEY}, process, feature, {_r("CASE WHEN value IS NULL THEN NULL WHEN direction = 'decreasing' THEN 100 - 100 * least(1.0, greatest(0.0, (value - lo) / (hi - lo))) ELSE 100 * least(1.0, greatest(0.0, (value - lo) / (hi - lo))) END AS score")}
FROM (SELECT {_KEY}, unnest(['area', 'convexity', 'anisometry', 'k_factor', 'roundness']) AS feature, unnest([area::DOUBLE, convexity, anisometry, k_factor, roundness]) AS value FROM ({_ALL}))
JOIN (VALUES ('coater', 'area', 1.0, 50.0, 'increasing'), ('coater', 'convexity', 0.4, 1.0, 'decreasing'), ('roll_press', 'anisometry', 1.0, 6.0, 'increasing'), ('roll_press', 'k_factor', 0.5, 3.0, 'decreasing'), ('slitter', 'roundness', 0.2, 1.0, 'decreasing')) AS p(process, feature, lo, hi, direction) USING (feature)"""),
    "q31_defect_codes": _sql([*_BASE, _FILLED, _HULL], f"""SELECT {_KEY}, 'coater' AS process, 'bubbles' AS code FROM ({_ALL}) WHERE holes >= 1 AND euler <= 0
UNION ALL SELECT {_KEY}, 'coater', 'tear' FROM ({_ALL}) WHERE convexity BETWEEN 0 AND 0.6 AND area >= 5
UNION ALL SELECT {_KEY}, 'roll_press', 'wrinkle' FROM ({_ALL}) WHERE anisometry >= 3
UNION ALL SELECT {_KEY}, 'slitter', 'burr' FROM ({_ALL}) WHERE roundness BETWEEN 0 AND 0.5"""),
    "q32_feature_vectors": _sql(_WIDE, _VECTOR),
    "q35_process_codes": _sql([*_WIDE, f"""vector AS (SELECT {_KEY}, m.area, holes, euler, {_CIRCULARITY} AS circularity, m.area / hull_area AS convexity, anisometry, {_ORIENTATION} AS orientation, m.area / (4 * rect2_long * rect2_short) AS rectangularity,
  roundness, sides, CASE WHEN diameter > 0 THEN contlength / diameter END AS contlength_by_diameter FROM {_JOINED})"""], " UNION ALL ".join(f"SELECT {_KEY}, '{p}' AS process, '{code}' AS code FROM vector WHERE {where}" for p, code, where in _CODES)),
    "q36_outer_contour": _sql([*_BASE, _RING], f"""SELECT {_KEY}, row_number() OVER (PARTITION BY {_KEY} ORDER BY n) - 1 AS k, r, c FROM ring WHERE step
UNION ALL SELECT {_KEY}, 0, r1, c1 FROM box WHERE area = 1"""),
    "q37_chain_length": _sql([*_BASE, _FILLED], f"SELECT {_KEY}, {_r('contlength')} FROM cont"),
    "q38_scored_vectors": _sql([*_BASE, _FILLED, _HULL], f"""SELECT {_KEY}, area, {_r("anisometry", "k_factor", "convexity", "roundness", "sides", *(f"CASE WHEN {v} IS NOT NULL THEN {100 if down else 0} {'-' if down else '+'} 100 * least(1.0, greatest(0.0, ({v} - {lo}) / ({hi} - {lo}))) END AS {p}_{v}" for p, v, lo, hi, down in _PROFILE))}
FROM ({_ALL}) JOIN (SELECT {_KEY}, sides FROM round_) USING ({_KEY})
UNION ALL SELECT {_KEY}, area, {_r("anisometry", "k_factor", "convexity", "NULL::DOUBLE AS roundness", "NULL::DOUBLE AS sides", *(f"CASE WHEN {v} IS NOT NULL THEN {100 if down else 0} {'-' if down else '+'} 100 * least(1.0, greatest(0.0, ({v} - {lo}) / ({hi} - {lo}))) END AS {p}_{v}" for p, v, lo, hi, down in _PROFILE[:-1]))}, NULL::DOUBLE AS slitter_roundness
FROM ({_ALL}) ANTI JOIN round_ USING ({_KEY})"""),
    "q39_bitmap_runs": _sql([], "SELECT * FROM runs"),
    "q40_strip_stream": _sql(_BASE, f"SELECT {_KEY}, area, {_r('row_ AS row', 'col_ AS col')}, r1, c1, r2, c2 FROM mom"),
    "q33_li_runs": _sql([], "SELECT * FROM runs", "li", 256),
    "q34_li_regions": _sql(_BASE[:1], f"SELECT {_KEY}, sum(c1 - c0 + 1)::BIGINT AS area, count(*) AS runs FROM reg GROUP BY 1, 2", "li", 256),
}
