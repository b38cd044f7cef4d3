"""DuckDB SQL for the registered queries, written apart from the Spark code: components by a recursive closure, windows of
pixels by joins with offset tables, transforms by explicit sums."""

from __future__ import annotations

from ..functions.kernels import ELLIPSE

PX = """px AS (SELECT CAST(floor(user_id / 5) AS INT) AS image_id, CAST(day(ts) - 1 AS INT) AS y, CAST(hour(ts) AS INT) AS x,
  CAST(least(255, floor(sum(value))) AS INT) AS v FROM events GROUP BY 1, 2, 3)"""
DENSE = """ys AS (SELECT CAST(range AS INT) AS y FROM range(30)), xs AS (SELECT CAST(range AS INT) AS x FROM range(24)),
dense AS (SELECT i.image_id, ys.y, xs.x, coalesce(px.v, 0) AS v FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN ys CROSS JOIN xs
  LEFT JOIN px ON px.image_id = i.image_id AND px.y = ys.y AND px.x = xs.x)"""


def off(name: str, r: int) -> str:
    return f"{name} AS (SELECT CAST(a.range AS INT) AS dy, CAST(b.range AS INT) AS dx FROM range({-r}, {r + 1}) a CROSS JOIN range({-r}, {r + 1}) b)"


def labelled(source: str = "px", cond: str = "v > 0") -> str:
    """Regions (8-connected components) of the pixels of a table that meet a condition: lab, and their numbers: regs."""
    return f"""{off("o1", 1)}, fg AS (SELECT image_id, y, x FROM {source} WHERE {cond}),
walk(image_id, y, x, root) AS (SELECT image_id, y, x, y * 24 + x FROM fg UNION
  SELECT b.image_id, b.y, b.x, w.root FROM walk w CROSS JOIN o1 JOIN fg b ON b.image_id = w.image_id AND b.y = w.y + o1.dy AND b.x = w.x + o1.dx),
comp AS (SELECT image_id, y, x, min(root) AS root FROM walk GROUP BY ALL),
lab AS (SELECT image_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INT) AS region_id, y, x FROM comp),
regs AS (SELECT image_id, region_id, count(*) AS area, min(x) AS x_min, min(y) AS y_min, max(x) + 1 AS x_max, max(y) + 1 AS y_max,
  CAST(floor(avg(x)) AS INT) AS cx, CAST(floor(avg(y)) AS INT) AS cy FROM lab GROUP BY ALL)"""


def ent(source: str, out: str) -> str:
    """Entropy of v per region of a table."""
    return f"""{out} AS (SELECT image_id, region_id, -sum(p * log2(p + 1e-8)) AS entropy FROM (
  SELECT image_id, region_id, count(*) / (sum(count(*)) OVER (PARTITION BY image_id, region_id) + 1e-8) AS p FROM {source} GROUP BY image_id, region_id, v) GROUP BY ALL)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


LAB = labelled()
OWN = "own AS (SELECT l.image_id, l.region_id, l.y, l.x, px.v FROM lab l JOIN px USING (image_id, y, x))"
INTENSITY = ent("own", "oe") + """,
inten AS (SELECT image_id, region_id, avg(v) AS mean, stddev_pop(v) AS std, stddev_pop(v) / (abs(avg(v)) + 1e-8) AS cv,
  quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, quantile_cont(v, 0.5) AS median, any_value(entropy) AS entropy
  FROM own JOIN oe USING (image_id, region_id) GROUP BY ALL)"""
ELL = "ell AS (SELECT * FROM (VALUES " + ", ".join(f"({i - 4}, {dx})" for i, w in enumerate(ELLIPSE[9]) for dx in range(-w, w + 1)) + ") AS t(dy, dx))"
RING = ELL + """,
ring AS (SELECT DISTINCT l.image_id, l.region_id, l.y + dy AS y, l.x + dx AS x FROM lab l CROSS JOIN ell
  WHERE l.y + dy BETWEEN 0 AND 29 AND l.x + dx BETWEEN 0 AND 23
  EXCEPT SELECT image_id, region_id, y, x FROM lab)"""
CROPS = """crop AS (SELECT r.image_id, r.region_id, ys.y, xs.x, coalesce(o.v, CAST(floor(i.median) AS INT)) AS v, o.v IS NOT NULL AS inside
  FROM regs r JOIN inten i USING (image_id, region_id) JOIN ys ON ys.y >= r.y_min - 3 AND ys.y < r.y_max + 3 JOIN xs ON xs.x >= r.x_min - 3 AND xs.x < r.x_max + 3
  LEFT JOIN own o ON o.image_id = r.image_id AND o.region_id = r.region_id AND o.y = ys.y AND o.x = xs.x WHERE r.area >= 4)"""
SEEDS = """seeds AS (SELECT event_id, CAST(floor(user_id / 5) AS INT) AS image_id, CAST(day(ts) - 1 AS INT) AS y,
  CAST(hour(ts) + CASE WHEN event_id % 50 = 0 THEN 24 ELSE 0 END AS INT) AS x,
  CASE WHEN event_type = 'click' THEN 'object' WHEN event_type = 'error' THEN 'background'
       WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'crystal' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'residue' END AS kind FROM events),
sd AS (SELECT * FROM seeds WHERE kind IS NOT NULL)"""
SL = SEEDS + """,
sl AS (SELECT image_id, region_id, CAST(bool_or(kind = 'object') AS INT) AS cls FROM sd JOIN lab USING (image_id, y, x) GROUP BY ALL
  HAVING bool_or(kind = 'object') <> bool_or(kind <> 'object'))"""
TXT = """tx AS (SELECT doc_id AS image_id, CAST(unnest(range(length(text))) AS INT) AS p, least(255, unicode(unnest(string_split(text, '')))) AS v FROM documents WHERE text <> ''),
txt AS (SELECT image_id, p // 64 AS y, p % 64 AS x, v FROM tx)"""
VEC = """vec AS (SELECT vec_id AS key, CAST(label < 5 AS INT) AS cls, CAST(unnest(range(len(embedding))) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
rk AS (SELECT vec_id, CAST(label < 5 AS INT) AS cls, row_number() OVER (PARTITION BY label < 5 ORDER BY md5('3:' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label < 5) AS n FROM embeddings),
sl AS (SELECT 25 * cls + slot.range AS proto_id, vec_id FROM rk JOIN range(25) slot ON slot.range % least(25, n) = r),
pro AS (SELECT sl.proto_id AS key, vec.cls, vec.i, vec.v FROM sl JOIN vec ON vec.key = sl.vec_id)"""
NEAR = """dist AS (SELECT a.key, b.key AS proto_id, any_value(a.cls) AS cls, any_value(b.cls) AS pred, sum((a.v - b.v) * (a.v - b.v)) AS d2 FROM {data} a JOIN pro b USING (i) GROUP BY a.key, b.key),
win AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY key ORDER BY d2, proto_id) = 1)"""
DEN8 = """e8 AS (SELECT vec_id AS image_id, CAST(unnest(range(len(embedding))) AS INT) AS p, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings),
d8 AS (SELECT image_id, p // 8 AS y, p % 8 AS x, CAST(floor((e - min(e) OVER w) * 255 / (max(e) OVER w - min(e) OVER w)) AS INT) AS v FROM e8 WINDOW w AS (PARTITION BY image_id))"""


def profile(source: str) -> str:
    return f"""prof AS (SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width, min(v) AS v_min, max(v) AS v_max, max(v) - min(v) AS v_range,
  avg(v) AS mean, stddev_pop(v) AS std, entropy(v) AS entropy FROM {source} GROUP BY image_id)"""


def otsu(source: str) -> str:
    """Each level's classes as sums over the histogram, joined with itself."""
    return f"""hist AS (SELECT image_id, v, count(*) AS n FROM {source} GROUP BY ALL),
cut AS (SELECT a.image_id, a.v AS t, sum(b.n) FILTER (WHERE b.v <= a.v) AS w0, sum(b.n * b.v) FILTER (WHERE b.v <= a.v) AS s0, sum(b.n) AS w, sum(b.n * b.v) AS s
  FROM hist a JOIN hist b USING (image_id) GROUP BY ALL),
var AS (SELECT image_id, t, CASE WHEN w0 < w THEN CAST(s0 * w - s * w0 AS DOUBLE) * (s0 * w - s * w0) / (CAST(w0 AS DOUBLE) * (w - w0)) ELSE 0 END AS var FROM cut),
thr AS (SELECT image_id, CASE WHEN max(var) > 0 THEN arg_min(t, (-var, t)) ELSE 0 END AS threshold FROM var GROUP BY image_id)"""


#: Reflection without repeating the edge, into 0..n-1.
def mirror(e: str, n: int) -> str:
    return f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} >= {n} THEN {2 * n - 2} - ({e}) ELSE {e} END"


def symmetric(e: str, n: int) -> str:
    return f"CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} >= {n} THEN {2 * n - 1} - ({e}) ELSE {e} END"


STENCIL = f"""{off("o1", 1)}, {off("o2", 2)}, {off("o9", 9)},
nine AS (SELECT d.image_id, d.y, d.x, o1.dy, o1.dx, n.v FROM dense d CROSS JOIN o1 JOIN dense n ON n.image_id = d.image_id AND n.y = {mirror("d.y + dy", 30)} AND n.x = {mirror("d.x + dx", 24)}),
der AS (SELECT image_id, y, x, sum(v * dx * (2 - abs(dy))) AS gx, sum(v * dy * (2 - abs(dx))) AS gy,
  sum(CASE WHEN dy = 0 AND dx = 0 THEN -4 * v WHEN dy = 0 OR dx = 0 THEN v ELSE 0 END) AS lap FROM nine GROUP BY ALL),
med AS (SELECT d.image_id, d.y, d.x, any_value(d.v) - median(n.v) AS rest FROM dense d CROSS JOIN o2
  JOIN dense n ON n.image_id = d.image_id AND n.y = greatest(0, least(29, d.y + dy)) AND n.x = greatest(0, least(23, d.x + dx)) GROUP BY ALL),
k1 AS (SELECT CAST(range AS INT) AS d, exp(-(range * range) / 18.0) AS g FROM range(-9, 10)), k AS (SELECT d, g / (SELECT sum(g) FROM k1) AS g FROM k1),
bl AS (SELECT d.image_id, d.y, d.x, round_even(sum(a.g * b.g * n.v), 0) AS b FROM dense d CROSS JOIN k a CROSS JOIN k b
  JOIN dense n ON n.image_id = d.image_id AND n.y = {mirror("d.y + a.d", 30)} AND n.x = {mirror("d.x + b.d", 24)} GROUP BY ALL),
sq AS (SELECT l.image_id, l.light_range, m.noise, g.sharpness, g.gradient FROM (SELECT image_id, max(b) - min(b) AS light_range FROM bl GROUP BY ALL) l
  JOIN (SELECT image_id, stddev_pop(rest) AS noise FROM med GROUP BY ALL) m USING (image_id)
  JOIN (SELECT image_id, var_pop(lap) AS sharpness, avg(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS gradient FROM der GROUP BY ALL) g USING (image_id))"""
FLAGS = STENCIL + ",\n" + profile("dense") + """,
fl AS (SELECT image_id, height, width, light_range > 16.0 AS uneven_light, noise > 19.0 AS noisy, noise > 22.0 AS very_noisy, sharpness < 15000.0 AS blurry, sharpness < 13000.0 AS very_blurry,
  std < 24.0 AS low_contrast, v_range < 130.0 AS narrow_range FROM prof JOIN sq USING (image_id))"""
U48 = "CAST(CAST('0x' || substr(md5({}), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656"

SQL: dict[str, str] = {
    "scan_images": """SELECT CAST(vec_id AS VARCHAR) || CASE WHEN vec_id % 2 = 1 THEN '.PNG' ELSE '.png' END AS image_id, 8 AS height, 8 AS width, 3 AS n_channels, 'ok' AS status FROM embeddings
        UNION ALL SELECT 'broken.png', -1, -1, -1, 'bad'""",
    "to_gray": with_(DEN8) + "SELECT image_id, y, x, (299 * v + 587 * (255 - v) + 114 * (v * 7 % 256) + 500) // 1000 AS v FROM d8",
    "annotation_store": with_(PX, LAB, SL) + "SELECT image_id, count(*) AS labels FROM sl GROUP BY image_id",
    "model_store": with_(VEC, NEAR.format(data="vec")) + "SELECT key AS vec_id, CAST(proto_id AS INT) AS proto_id, round(d2, 6) AS d2, pred, (SELECT count(DISTINCT i) FROM vec) AS n_features FROM win",
    "write_results": with_(PX, LAB) + "SELECT image_id, count(DISTINCT region_id) AS regions, count(*) AS pixels FROM lab GROUP BY image_id",
    "image_profile": with_(PX, profile("px")) + "SELECT image_id, height, width, v_min, v_max, v_range, round(mean, 6) AS mean, round(std, 6) AS std, round(entropy, 6) AS entropy FROM prof",
    "text_profile": with_(TXT, profile("txt")) + "SELECT image_id, height, width, v_min, v_max, v_range, round(mean, 6) AS mean, round(std, 6) AS std, round(entropy, 6) AS entropy FROM prof",
    "gray_histogram": with_(TXT) + "SELECT image_id, v, count(*) AS n FROM txt GROUP BY ALL",
    "otsu_threshold": with_(PX, otsu("px")) + "SELECT image_id, CAST(threshold AS INT) AS threshold FROM thr",
    "text_otsu": with_(TXT, otsu("txt")) + "SELECT image_id, count(CASE WHEN v > threshold THEN 1 END) AS n_over FROM txt JOIN thr USING (image_id) GROUP BY ALL",
    "minmax_norm": with_(PX) + "SELECT image_id, y, x, CAST(CASE WHEN max(v) OVER w > min(v) OVER w THEN floor((v - min(v) OVER w) * 255 / (max(v) OVER w - min(v) OVER w)) ELSE 0 END AS INT) AS v FROM px WINDOW w AS (PARTITION BY image_id)",
    "contrast_stretch": with_(PX, "e AS (SELECT image_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM px GROUP BY 1)")
    + "SELECT image_id, y, x, CAST(CASE WHEN hi > lo THEN floor(greatest(0.0, least(255.0, (v - lo) * 255 / (hi - lo)))) ELSE v END AS INT) AS v FROM px JOIN e USING (image_id)",
    "gamma_lut": with_(PX) + "SELECT image_id, y, x, CAST(floor(pow(v / 255, 1.0::DOUBLE / 2.2::DOUBLE) * 255) AS INT) AS v FROM px",
    "top2_values": with_(PX, "r AS (SELECT image_id, v, dense_rank() OVER (PARTITION BY image_id ORDER BY v DESC) AS k FROM px)")
    + "SELECT image_id, max(v) AS first, max(v) FILTER (WHERE k = 2) AS second, count(*) FILTER (WHERE k <= 2 AND v > 0) AS n_pixels FROM r GROUP BY image_id",
    "mask_algebra": with_(PX) + """SELECT image_id, y, x, 'and' AS how FROM px WHERE v > 20 AND x % 2 = 0 UNION ALL SELECT image_id, y, x, 'minus' FROM px WHERE v > 20 AND x % 2 <> 0
        UNION ALL SELECT image_id, y, x, 'or' FROM px WHERE v > 20 OR (v > 5 AND x % 2 = 0)""",
    "image_stencil_qc": with_(PX, DENSE, STENCIL) + "SELECT image_id, round(light_range, 6) AS light_range, round(noise, 6) AS noise, round(sharpness, 6) AS sharpness, round(gradient, 6) AS gradient FROM sq",
    "qc_flags": with_(PX, DENSE, FLAGS) + "SELECT image_id, uneven_light, noisy, blurry, low_contrast, narrow_range FROM fl",
    "qc_plan": with_(PX, DENSE, FLAGS) + """, st AS (
        SELECT image_id, 0 AS o, 'light' AS name, 'homomorphic' AS method, CAST(least(height, width) // 8 AS DOUBLE) AS sigma FROM fl WHERE uneven_light
        UNION ALL SELECT image_id, 1, CASE WHEN very_noisy THEN 'denoise_strong' ELSE 'denoise' END, CASE WHEN very_noisy THEN 'non_local_means' ELSE 'bilateral' END, NULL FROM fl WHERE very_noisy OR noisy
        UNION ALL SELECT image_id, 2, 'contrast', 'clahe', NULL FROM fl WHERE low_contrast OR narrow_range
        UNION ALL SELECT image_id, 3, CASE WHEN very_blurry THEN 'sharpen_strong' ELSE 'sharpen' END, 'unsharp', 1.5 FROM fl WHERE very_blurry OR blurry)
        SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY o) - 1 AS INT) AS step, name, method, sigma FROM st""",
    "corpus_quantiles": with_(TXT, profile("txt"), "q AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS share)")
    + " UNION ALL ".join(f"SELECT '{c}' AS metric, share, round((SELECT quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) FROM prof)[CAST(share * 4 AS INT)], 6) AS value FROM q" for c in ("v_range", "mean", "std", "entropy")),
    "connected_components": with_(PX, LAB) + "SELECT image_id, region_id, y, x FROM lab",
    "region_stats": with_(PX, LAB) + "SELECT * FROM regs",
    "area_filter": with_(PX, LAB) + "SELECT * FROM regs WHERE area >= 20",
    "relabel": with_(PX, LAB) + "SELECT image_id, region_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY region_id) AS INT) AS new_id, area FROM regs WHERE area >= 4",
    "padded_bbox": with_(PX, LAB) + "SELECT image_id, region_id, greatest(x_min - 8, 0) AS px_min, greatest(y_min - 8, 0) AS py_min, least(x_max + 8, 24) AS px_max, least(y_max + 8, 30) AS py_max FROM regs",
    "border_context": with_(PX, LAB) + "SELECT image_id, region_id, CAST(x_min <= 3 OR y_min <= 3 OR x_max >= 21 OR y_max >= 27 AS INT) AS touches_border, round(least(x_min, y_min, 24 - x_max, 30 - y_max) / 24, 6) AS border_distance FROM regs",
    "region_pixels": with_(PX, LAB, OWN) + "SELECT image_id, region_id, y, x, v FROM own",
    "region_intensity": with_(PX, LAB, OWN, INTENSITY) + "SELECT image_id, region_id, round(mean, 6) AS mean, round(std, 6) AS std, round(cv, 6) AS cv, round(iqr, 6) AS iqr, round(median, 6) AS median, round(entropy, 6) AS entropy FROM inten",
    "region_ring": with_(PX, LAB, RING) + "SELECT image_id, region_id, y, x FROM ring",
    "region_contrast": with_(PX, LAB, OWN, INTENSITY, RING, "rv AS (SELECT r.image_id, r.region_id, coalesce(px.v, 0) AS v FROM ring r LEFT JOIN px USING (image_id, y, x))", ent("rv", "re"))
    + """SELECT i.image_id, i.region_id, round(coalesce(i.mean - g.m, 0), 6) AS contrast_mean, round(coalesce(i.std / (g.s + 1e-8), 0), 6) AS contrast_std, round(coalesce(i.entropy - re.entropy, 0), 6) AS contrast_entropy
        FROM inten i LEFT JOIN (SELECT image_id, region_id, avg(v) AS m, stddev_pop(v) AS s FROM rv GROUP BY ALL) g USING (image_id, region_id) LEFT JOIN re USING (image_id, region_id)""",
    "region_glcm": with_(PX, DENSE, LAB, OWN, INTENSITY, CROPS) + """, st AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) AS t(a, dy, dx)),
        pr AS (SELECT c.image_id, c.region_id, a, c.v // 8 AS i, n.v // 8 AS j FROM crop c CROSS JOIN st JOIN crop n ON n.image_id = c.image_id AND n.region_id = c.region_id AND n.y = c.y + dy AND n.x = c.x + dx),
        sy AS (SELECT image_id, region_id, a, i, j FROM pr UNION ALL SELECT image_id, region_id, a, j, i FROM pr),
        ce AS (SELECT image_id, region_id, a, i, j, count(*) / (sum(count(*)) OVER (PARTITION BY image_id, region_id, a)) AS p FROM sy GROUP BY image_id, region_id, a, i, j),
        mo AS (SELECT image_id, region_id, a, sum(p * i) AS m, sum(p * i * i) - sum(p * i) * sum(p * i) AS s2, sum(p * i * j) - sum(p * i) * sum(p * i) AS cov,
          sum(p * (i - j) * (i - j)) AS con, sum(p * abs(i - j)) AS dis, sum(p / (1 + (i - j) * (i - j))) AS hom, sqrt(sum(p * p)) AS en FROM ce GROUP BY ALL)
        SELECT image_id, region_id, round(sum(con) / 4, 6) AS glcm_contrast, round(sum(dis) / 4, 6) AS glcm_dissimilarity, round(sum(hom) / 4, 6) AS glcm_homogeneity, round(sum(en) / 4, 6) AS glcm_energy,
          round(sum(CASE WHEN s2 < 1e-12 THEN 1 ELSE cov / s2 END) / 4, 6) AS glcm_correlation FROM mo GROUP BY ALL""",
    "region_lbp": with_(PX, DENSE, LAB, OWN, INTENSITY, CROPS) + """, pt AS (SELECT * FROM (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) AS t(k, dy, dx)),
        nb AS (SELECT c.image_id, c.region_id, c.y, c.x, c.v AS c, k, dy, dx, coalesce(a.v, 0) AS p, coalesce(b.v, 0) AS q, coalesce(e.v, 0) AS r FROM crop c CROSS JOIN pt
          LEFT JOIN crop a ON a.image_id = c.image_id AND a.region_id = c.region_id AND a.y = c.y + dy AND a.x = c.x + dx
          LEFT JOIN crop b ON b.image_id = c.image_id AND b.region_id = c.region_id AND b.y = c.y + dy AND b.x = c.x
          LEFT JOIN crop e ON e.image_id = c.image_id AND e.region_id = c.region_id AND e.y = c.y AND e.x = c.x + dx WHERE c.inside),
        bt AS (SELECT image_id, region_id, y, x, k, CAST(round(CASE WHEN dy = 0 OR dx = 0 THEN p - c ELSE (1 - sqrt(0.5)) * (1 - sqrt(0.5)) * c + (1 - sqrt(0.5)) * sqrt(0.5) * (q + r) + 0.5 * p - c END, 9) >= 0 AS INT) AS b FROM nb),
        tn AS (SELECT s.image_id, s.region_id, s.y, s.x, sum(s.b) AS ones, sum(CAST(s.b <> t.b AS INT)) AS turns FROM bt s JOIN bt t ON t.image_id = s.image_id AND t.region_id = s.region_id AND t.y = s.y AND t.x = s.x AND t.k = (s.k + 1) % 8 GROUP BY ALL),
        hg AS (SELECT image_id, region_id, count(*) / (sum(count(*)) OVER (PARTITION BY image_id, region_id) + 1e-8) AS p FROM tn GROUP BY image_id, region_id, CASE WHEN turns <= 2 THEN ones ELSE 9 END)
        SELECT image_id, region_id, round(sum(p * p), 6) AS lbp_uniformity, round(-sum(p * log2(p + 1e-8)), 6) AS lbp_entropy FROM hg GROUP BY ALL""",
    "flagship": with_(PX, otsu("px"), "ov AS (SELECT image_id, y, x, v FROM px JOIN thr USING (image_id) WHERE v > threshold)", labelled("ov", "true"), OWN, INTENSITY)
    + """SELECT r.image_id, area, x_min, y_min, x_max, y_max, cx, cy, CAST(row_number() OVER (PARTITION BY r.image_id ORDER BY r.region_id) AS INT) AS new_id, round(mean, 6) AS mean, round(std, 6) AS std,
        round(cv, 6) AS cv, round(iqr, 6) AS iqr, round(median, 6) AS median, round(entropy, 6) AS entropy FROM regs r JOIN inten i USING (image_id, region_id) WHERE area >= 4""",
    "frequency_filter": with_(DEN8) + """, fr AS (SELECT CAST(a.range AS INT) AS ky, CAST(b.range AS INT) AS kx FROM range(-4, 4) a CROSS JOIN range(-4, 4) b WHERE a.range * a.range + b.range * b.range >= 4),
        sp AS (SELECT image_id, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) AS re, -sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) AS im FROM d8 CROSS JOIN fr GROUP BY ALL),
        ba AS (SELECT s.image_id, p.y, p.x, sum(re * cos(2 * pi() * (ky * p.y + kx * p.x) / 8) - im * sin(2 * pi() * (ky * p.y + kx * p.x) / 8)) / 64 AS re, sum(re * sin(2 * pi() * (ky * p.y + kx * p.x) / 8) + im * cos(2 * pi() * (ky * p.y + kx * p.x) / 8)) / 64 AS im
          FROM sp s CROSS JOIN (SELECT DISTINCT y, x FROM d8) p GROUP BY ALL),
        mg AS (SELECT image_id, y, x, sqrt(re * re + im * im) AS m FROM ba)
        SELECT image_id, y, x, CAST(floor((m - min(m) OVER w) * (255 / (max(m) OVER w - min(m) OVER w)) + 1e-9) AS INT) AS v FROM mg WINDOW w AS (PARTITION BY image_id)""",
    "local_entropy": with_(PX, DENSE, off("o6", 6)) + f""", cn AS (SELECT d.image_id, d.y, d.x, n.v, count(*) AS n FROM dense d CROSS JOIN o6
          JOIN dense n ON n.image_id = d.image_id AND n.y = {symmetric("d.y + dy", 30)} AND n.x = {symmetric("d.x + dx", 24)} GROUP BY ALL)
        SELECT image_id, y, x, CAST(floor(log2(169) - sum(n * log2(n)) / 169 + 1e-9) AS INT) AS v FROM cn GROUP BY image_id, y, x""",
    "morphology": with_(PX, DENSE, off("o1", 1)) + """SELECT DISTINCT image_id, y + dy AS y, x + dx AS x, 'dilate' AS how FROM px CROSS JOIN o1 WHERE v > 0 AND y + dy BETWEEN 0 AND 29 AND x + dx BETWEEN 0 AND 23
        UNION ALL SELECT d.image_id, d.y, d.x, 'erode' FROM dense d CROSS JOIN o1 JOIN dense n ON n.image_id = d.image_id AND n.y = d.y + dy AND n.x = d.x + dx GROUP BY d.image_id, d.y, d.x HAVING min(n.v) > 0""",
    "fill_holes": with_(PX, DENSE, "o4 AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS t(dy, dx))", """out(image_id, y, x) AS (SELECT image_id, y, x FROM dense WHERE y = 0 AND x = 0 AND v = 0 UNION
          SELECT n.image_id, n.y, n.x FROM out o CROSS JOIN o4 JOIN dense n ON n.image_id = o.image_id AND n.y = o.y + dy AND n.x = o.x + dx WHERE n.v = 0)""")
    + "SELECT image_id, y, x FROM dense d WHERE NOT EXISTS (SELECT 1 FROM out o WHERE o.image_id = d.image_id AND o.y = d.y AND o.x = d.x)",
    "median_filter": with_(PX, DENSE, off("o1", 1)) + "SELECT d.image_id, d.y, d.x, CAST(median(n.v) AS INT) AS v FROM dense d CROSS JOIN o1 JOIN dense n ON n.image_id = d.image_id AND n.y = greatest(0, least(29, d.y + dy)) AND n.x = greatest(0, least(23, d.x + dx)) GROUP BY ALL",
    "negative_seeds": with_(SEEDS) + "SELECT * FROM sd WHERE kind <> 'object'",
    "seed_labels": with_(PX, LAB, SL) + "SELECT * FROM sl",
    "valid_clicks": with_(PX, LAB, SEEDS) + "SELECT event_id, image_id, y, x, region_id FROM sd JOIN lab USING (image_id, y, x)",
    "unlabelled_regions": with_(PX, LAB, SL) + "SELECT image_id, region_id, area FROM regs WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.image_id = regs.image_id AND sl.region_id = regs.region_id)",
    "labelled_images": with_(PX, LAB, SL) + "SELECT DISTINCT image_id FROM sl",
    "label_summary": with_(PX, LAB, SL) + """SELECT image_id, count(*) AS regions, count(*) FILTER (WHERE cls = 1) AS positive, count(*) FILTER (WHERE cls = 0) AS negative, count(*) FILTER (WHERE cls IS NULL) AS unlabelled
        FROM regs LEFT JOIN sl USING (image_id, region_id) GROUP BY image_id""",
    "labelled_dataset": with_(PX, LAB, OWN, INTENSITY, SL) + "SELECT image_id, region_id, cls, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median FROM inten JOIN sl USING (image_id, region_id)",
    "class_counts": "SELECT CAST(label < 5 AS INT) AS cls, count(*) AS n FROM embeddings GROUP BY 1",
    "class_raster": with_(PX, LAB, SL) + "SELECT image_id, region_id, y, x FROM lab JOIN sl USING (image_id, region_id) WHERE cls = 1",
    "accepted_regions": with_(PX, LAB, SL) + """SELECT image_id, CAST(k AS INT) AS region_id, y, x FROM lab JOIN (SELECT image_id, region_id, row_number() OVER (PARTITION BY image_id ORDER BY region_id) AS k FROM sl WHERE cls = 1) USING (image_id, region_id)""",
    "fit_scaler": with_(VEC) + "SELECT i AS feature_idx, round(avg(v), 6) AS mu, round(CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END, 6) AS sigma FROM vec GROUP BY i",
    "apply_scaler": with_(VEC) + "SELECT key, i AS feature_idx, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w), 6) AS z FROM vec WINDOW w AS (PARTITION BY i)",
    "train_val_split": "SELECT vec_id AS key, CASE WHEN row_number() OVER (ORDER BY md5('7:' || vec_id)) <= greatest(1, least((SELECT count(*) FROM embeddings) - 1, round_even((SELECT count(*) FROM embeddings) * 0.2::DOUBLE, 0))) THEN 'val' ELSE 'train' END AS part FROM embeddings",
    "class_ranges": with_(VEC) + "SELECT cls, i AS feature_idx, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(CASE WHEN stddev_pop(v) < 1e-6 THEN 0.01 ELSE stddev_pop(v) END, 6) AS sd FROM vec GROUP BY ALL",
    "init_prototypes": with_(VEC) + """, pk AS (SELECT vec_id AS key, cls, row_number() OVER (ORDER BY cls, r) - 1 AS proto_id FROM rk WHERE r < CASE WHEN cls = 0 THEN 21 ELSE 20 END)
        SELECT CAST(proto_id AS INT) AS proto_id, pk.cls, i AS feature_idx, round(v, 6) AS v FROM pk JOIN vec USING (key)""",
    "nearest_prototype": with_(VEC, NEAR.format(data="vec")) + "SELECT key AS vec_id, CAST(proto_id AS INT) AS proto_id, round(d2, 6) AS d2, pred FROM win",
    "accuracy": with_(VEC, NEAR.format(data="vec")) + "SELECT round(avg(CAST(pred = cls AS INT)), 6) AS accuracy FROM win",
    "topk_per_prototype": with_(VEC, NEAR.format(data="vec")) + """, tk AS (SELECT * FROM win WHERE pred = cls QUALIFY row_number() OVER (PARTITION BY proto_id ORDER BY d2, key) <= 7)
        SELECT CAST(proto_id AS INT) AS proto_id, count(*) AS n, i AS feature_idx, round(avg(v), 6) AS mean_v FROM tk JOIN vec USING (key) GROUP BY proto_id, i""",
    "hlvq_epoch": with_(VEC, NEAR.format(data="vec")) + """, pu AS (SELECT proto_id, i, sum(v) AS s, count(*) AS n FROM win JOIN vec USING (key) WHERE win.pred <> win.cls GROUP BY ALL),
        w1 AS (SELECT p.key AS proto_id, p.cls, p.i, p.v - coalesce(least(0.25::DOUBLE * 0.3::DOUBLE, 1.0::DOUBLE / n) * (s - n * p.v), 0) AS w FROM pro p LEFT JOIN pu ON pu.proto_id = p.key AND pu.i = p.i),
        d1 AS (SELECT win.key, win.proto_id, sum((vec.v - w1.w) * (vec.v - w1.w)) AS d2 FROM win JOIN vec USING (key) JOIN w1 ON w1.proto_id = win.proto_id AND w1.i = vec.i WHERE win.pred = win.cls GROUP BY ALL),
        tk AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY proto_id ORDER BY d2, key) <= 7),
        me AS (SELECT proto_id, i, avg(v) AS m FROM tk JOIN vec USING (key) GROUP BY ALL)
        SELECT CAST(w1.proto_id AS INT) AS proto_id, w1.cls, w1.i AS feature_idx, round(w + coalesce(0.3::DOUBLE * (m - w), 0), 6) AS v FROM w1 LEFT JOIN me ON me.proto_id = w1.proto_id AND me.i = w1.i""",
    "dropout_mask": with_(VEC) + f""", u AS (SELECT CAST(key AS INT) AS proto_id, cls, {U48.format("'0:drop:20:' || key")} AS u FROM pro WHERE i = 0)
        SELECT proto_id, cls, u >= 0.5 OR row_number() OVER (PARTITION BY cls ORDER BY u DESC, proto_id) = 1 AS active FROM u""",
    "reseed_prototypes": with_(VEC) + f""", rg AS (SELECT cls, i, min(v) AS lo, max(v) AS hi FROM vec GROUP BY ALL)
        SELECT CAST(key AS INT) AS proto_id, p.cls, p.i AS feature_idx, round(CASE WHEN key % 3 = 0 THEN lo + (hi - lo) * ({U48.format("'0:box:5:' || key || ':' || p.i")}) ELSE v END, 6) AS v FROM pro p JOIN rg ON rg.cls = p.cls AND rg.i = p.i""",
    "best_epoch": """WITH RECURSIVE h AS (SELECT CAST(user_id AS INT) AS epoch, round(avg(value), 2) AS acc, row_number() OVER (ORDER BY user_id) AS k FROM events GROUP BY user_id),
        f(k, best, acc, bad, stop) AS (SELECT CAST(0 AS BIGINT), -1, -1.0::DOUBLE, 0, -1 UNION ALL
          SELECT h.k, CASE WHEN h.acc > f.acc THEN h.epoch ELSE f.best END, CASE WHEN h.acc > f.acc THEN h.acc ELSE f.acc END, CASE WHEN h.acc > f.acc THEN 0 ELSE f.bad + 1 END, h.epoch
          FROM f JOIN h ON h.k = f.k + 1 WHERE f.bad < 40)
        SELECT best AS best_epoch, acc AS best_acc, stop AS stop_epoch FROM f ORDER BY k DESC LIMIT 1""",
    "stream_new_images": with_(PX, DENSE, STENCIL) + "SELECT image_id, round(light_range, 6) AS light_range, round(noise, 6) AS noise, round(sharpness, 6) AS sharpness, round(gradient, 6) AS gradient FROM sq",
}

_REPLAY = """WITH e AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(json_extract(props, '$.k') AS INT) % 4 AS image_id,
          CASE WHEN event_type = 'click' THEN 'click' WHEN event_type = 'error' THEN 'undo' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'clear' WHEN event_type = 'view' THEN 'mode1' WHEN event_type = 'purchase' THEN 'mode0' END AS action,
          CAST(event_id % 7 AS INT) AS region_id FROM events),
        m AS (SELECT *, coalesce((SELECT CAST(action = 'mode1' AS INT) FROM e p WHERE p.session_id = e.session_id AND p.seq <= e.seq AND p.action IN ('mode0', 'mode1') ORDER BY p.seq DESC LIMIT 1), 1) AS cls FROM e
          WHERE action IN ('undo', 'clear') OR (action = 'click' AND region_id > 0)),
        l AS (SELECT session_id, image_id, max(seq) AS cleared FROM m WHERE action = 'clear' GROUP BY ALL),
        a AS (SELECT m.*, sum(CASE WHEN action = 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY m.session_id, m.image_id ORDER BY m.seq) AS s FROM m LEFT JOIN l USING (session_id, image_id) WHERE m.seq > coalesce(cleared, 0)),
        d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY session_id, image_id ORDER BY seq)) AS depth FROM a),
        c AS (SELECT * FROM d WHERE action = 'click' AND NOT EXISTS (SELECT 1 FROM d u WHERE u.session_id = d.session_id AND u.image_id = d.image_id AND u.seq > d.seq AND u.depth < d.depth))
        SELECT session_id, image_id, region_id, arg_max(cls, seq) AS cls FROM c GROUP BY ALL"""
SQL["annotation_replay"] = SQL["stream_annotations"] = _REPLAY


def _grow(name: str, source: str, by: str = "e5") -> str:
    return f"{name} AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM {source} CROSS JOIN {by} WHERE y + dy BETWEEN 0 AND 29 AND x + dx BETWEEN 0 AND 23)"


def _shrink(name: str, source: str, by: str = "e5") -> str:
    return f"""{name} AS (SELECT d.image_id, d.y, d.x FROM dense d CROSS JOIN {by} LEFT JOIN {source} s ON s.image_id = d.image_id AND s.y = d.y + dy AND s.x = d.x + dx
  WHERE d.y + dy BETWEEN 0 AND 29 AND d.x + dx BETWEEN 0 AND 23 GROUP BY d.image_id, d.y, d.x HAVING count(s.image_id) = count(*))"""


_E5 = ", ".join(f"({i - 2}, {dx})" for i, w in enumerate(ELLIPSE[5]) for dx in range(-w, w + 1))
SQL["clean_mask"] = f"""WITH RECURSIVE {PX}, {DENSE}, e5 AS (SELECT * FROM (VALUES {_E5}) AS t(dy, dx)), m0 AS (SELECT image_id, y, x FROM px WHERE v > 0),
{_grow("m1", "m0")}, {_grow("m2", "m1")}, {_shrink("m3", "m2")}, {_shrink("m4", "m3")}, {_shrink("m5", "m4")}, {_shrink("m6", "m5")}, {_grow("m7", "m6")}, {_grow("m8", "m7")},
free AS (SELECT d.image_id, d.y, d.x FROM dense d ANTI JOIN m8 m ON m.image_id = d.image_id AND m.y = d.y AND m.x = d.x), o4 AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS t(dy, dx)),
out(image_id, y, x) AS (SELECT image_id, y, x FROM free WHERE y = 0 AND x = 0 UNION SELECT n.image_id, n.y, n.x FROM out o CROSS JOIN o4 JOIN free n ON n.image_id = o.image_id AND n.y = o.y + dy AND n.x = o.x + dx),
filled AS (SELECT d.image_id, d.y, d.x FROM dense d ANTI JOIN out o ON o.image_id = d.image_id AND o.y = d.y AND o.x = d.x), {labelled("filled", "TRUE")}
SELECT image_id, y, x FROM lab JOIN regs USING (image_id, region_id) WHERE area >= 50"""

_PHASE = "2 * pi() * (ky * y / 30.0::DOUBLE + kx * x / 24.0::DOUBLE)"
#: The rasters less their waves under radius 4, as magnitudes stretched to bytes, and the pixels over the Otsu level.
_OVER = f"""wave AS (SELECT CAST(a.range AS INT) AS ky, CAST(b.range AS INT) AS kx FROM range(-3, 4) a CROSS JOIN range(-3, 4) b WHERE a.range * a.range + b.range * b.range < 16),
sp AS (SELECT image_id, ky, kx, sum(v * cos({_PHASE})) AS re, -sum(v * sin({_PHASE})) AS im FROM dense CROSS JOIN wave GROUP BY ALL),
slow AS (SELECT image_id, y, x, any_value(v) AS v, sum(re * cos({_PHASE}) - im * sin({_PHASE})) / 720 AS low FROM dense JOIN sp USING (image_id) GROUP BY ALL),
mg AS (SELECT image_id, y, x, CASE WHEN abs(v - low) < 1e-9 * greatest(1, max(v) OVER (PARTITION BY image_id)) THEN 0 ELSE abs(v - low) END AS m FROM slow),
en AS (SELECT *, min(m) OVER w AS lo, max(m) OVER w AS hi FROM mg WINDOW w AS (PARTITION BY image_id)),
fl AS (SELECT image_id, y, x, CAST(CASE WHEN hi - lo > 1e-9 * greatest(1, hi) THEN floor((m - lo) * (255 / (hi - lo)) + 1e-9) ELSE 0 END AS INT) AS v FROM en),
{otsu("fl")}, over AS (SELECT image_id, y, x FROM fl JOIN thr USING (image_id) WHERE v > threshold)"""
SQL["candidate_mask"] = with_(
    PX, DENSE, _OVER, off("sq3", 1), _grow("m1", "over", "sq3"), _grow("m2", "m1", "sq3"), _grow("m3", "m2", "sq3"), _shrink("m4", "m3", "sq3"), labelled("m4", "TRUE"), off("o6", 6),
    f"""cn AS (SELECT d.image_id, d.y, d.x, n.v, count(*) AS n FROM fl d CROSS JOIN o6
  JOIN fl n ON n.image_id = d.image_id AND n.y = {symmetric("d.y + dy", 30)} AND n.x = {symmetric("d.x + dx", 24)} GROUP BY ALL),
bits AS (SELECT image_id, y, x, floor(log2(169) - sum(n * log2(n)) / 169 + 1e-9) AS e FROM cn GROUP BY image_id, y, x)""",
) + """SELECT image_id, y, x FROM (SELECT * FROM bits JOIN lab USING (image_id, y, x) JOIN regs USING (image_id, region_id) WHERE area >= 20 AND e > 0) QUALIFY dense_rank() OVER (PARTITION BY image_id ORDER BY e DESC) <= 2"""
SQL["candidate_mask_simple"] = with_(
    PX, DENSE, _OVER, f"e5 AS (SELECT * FROM (VALUES {_E5}) AS t(dy, dx))", _grow("m1", "over"), _shrink("m2", "m1"), _shrink("m3", "m2"), _shrink("m4", "m3"), _grow("m5", "m4"), _grow("m6", "m5"),
    "free AS (SELECT d.image_id, d.y, d.x FROM dense d ANTI JOIN m6 m ON m.image_id = d.image_id AND m.y = d.y AND m.x = d.x), o4 AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS t(dy, dx))",
    "out(image_id, y, x) AS (SELECT image_id, y, x FROM free WHERE y = 0 AND x = 0 UNION SELECT n.image_id, n.y, n.x FROM out o CROSS JOIN o4 JOIN free n ON n.image_id = o.image_id AND n.y = o.y + dy AND n.x = o.x + dx)",
) + "SELECT d.image_id, d.y, d.x FROM dense d ANTI JOIN out o ON o.image_id = d.image_id AND o.y = d.y AND o.x = d.x"

_GAINS = {
    "high_ideal": "CASE WHEN d >= 2 THEN 1 ELSE 0 END", "low_ideal": "CASE WHEN d <= 2 THEN 1 ELSE 0 END", "band": "CASE WHEN d >= 1 AND d <= 3 THEN 1 ELSE 0 END",
    "high_gaussian": "1 - exp(-d * d / 8)", "low_gaussian": "exp(-d * d / 8)", "high_butterworth": "1 / (1 + pow(2 / (d + 1e-8), 4))", "low_butterworth": "1 / (1 + pow(d / 2, 4))",
}
_FORWARD = SQL["frequency_filter"][: SQL["frequency_filter"].index(", fr AS")]
SQL["frequency_filter_kinds"] = f"""{_FORWARD}, fr AS (SELECT CAST(a.range AS INT) AS ky, CAST(b.range AS INT) AS kx, sqrt(CAST(a.range * a.range + b.range * b.range AS DOUBLE)) AS d FROM range(-4, 4) a CROSS JOIN range(-4, 4) b),
kinds AS (SELECT * FROM (VALUES {", ".join(f"('{k}')" for k in _GAINS)}) AS t(kind)),
gain AS (SELECT kind, ky, kx, CAST(CASE kind {" ".join(f"WHEN '{k}' THEN {g}" for k, g in _GAINS.items())} END AS DOUBLE) AS g FROM fr CROSS JOIN kinds),
sp AS (SELECT image_id, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) AS re, -sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) AS im FROM d8 CROSS JOIN fr GROUP BY ALL),
ba AS (SELECT s.image_id, kind, p.y, p.x, sum(g * (re * cos(2 * pi() * (s.ky * p.y + s.kx * p.x) / 8) - im * sin(2 * pi() * (s.ky * p.y + s.kx * p.x) / 8))) / 64 AS re,
  sum(g * (re * sin(2 * pi() * (s.ky * p.y + s.kx * p.x) / 8) + im * cos(2 * pi() * (s.ky * p.y + s.kx * p.x) / 8))) / 64 AS im
  FROM sp s JOIN gain USING (ky, kx) CROSS JOIN (SELECT DISTINCT y, x FROM d8) p GROUP BY ALL),
mg AS (SELECT image_id, kind, CASE WHEN sqrt(re * re + im * im) < 1e-9 * 255 THEN 0 ELSE sqrt(re * re + im * im) END AS m FROM ba),
en AS (SELECT image_id, kind, m, min(m) OVER w AS lo, max(m) OVER w AS hi FROM mg WINDOW w AS (PARTITION BY image_id, kind))
SELECT image_id, kind, CAST(sum(CASE WHEN hi - lo > 1e-9 * greatest(1, hi) THEN floor((m - lo) * (255 / (hi - lo)) + 1e-9) ELSE 0 END) AS BIGINT) AS total FROM en GROUP BY image_id, kind"""

#: Sobel and Laplacian of the filled crops, mirrored at their edges without repeating the edge, on object pixels.
SQL["region_gradient"] = with_(PX, DENSE, LAB, OWN, INTENSITY, CROPS) + """, bx AS (SELECT image_id, region_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM crop GROUP BY ALL),
st AS (SELECT a.range AS dy, b.range AS dx FROM range(-1, 2) a CROSS JOIN range(-1, 2) b),
nb AS (SELECT image_id, region_id, c.y, c.x, dy, dx, CASE WHEN c.y + dy < y0 THEN y0 + 1 WHEN c.y + dy > y1 THEN y1 - 1 ELSE c.y + dy END AS ny,
  CASE WHEN c.x + dx < x0 THEN x0 + 1 WHEN c.x + dx > x1 THEN x1 - 1 ELSE c.x + dx END AS nx FROM crop c JOIN bx USING (image_id, region_id) CROSS JOIN st WHERE inside),
gr AS (SELECT n.image_id, n.region_id, n.y, n.x, CAST(sum(v * dx * (2 - abs(dy))) AS DOUBLE) AS gx, CAST(sum(v * dy * (2 - abs(dx))) AS DOUBLE) AS gy,
  CAST(sum(v * CASE abs(dy) + abs(dx) WHEN 0 THEN -4 WHEN 1 THEN 1 ELSE 0 END) AS DOUBLE) AS lp
  FROM nb n JOIN crop c ON c.image_id = n.image_id AND c.region_id = n.region_id AND c.y = n.ny AND c.x = n.nx GROUP BY ALL)
SELECT image_id, region_id, round(avg(sqrt(gx * gx + gy * gy)), 6) AS gradient_mean, round(stddev_pop(sqrt(gx * gx + gy * gy)), 6) AS gradient_std, round(var_pop(lp), 6) AS laplacian_var FROM gr GROUP BY ALL"""


def _draw(tag: str) -> str:
    """A number in [0, 1) from the MD5 of seed, tag and epoch."""
    return f"CAST('0x' || substr(md5('0:{tag}:' || range), 1, 12) AS BIGINT) / 281474976710656::DOUBLE"


_SCALE = "pow(gamma(2.5) * sin(pi() * 0.75) / (gamma(1.25) * 1.5 * pow(2, 0.25)), 1 / 1.5)"
SQL["levy_alpha"] = f"""WITH e AS (SELECT count(DISTINCT date_trunc('hour', ts)) AS n FROM events),
d AS (SELECT range, range / n::DOUBLE AS t, {_draw("a")} AS a, {_draw("b")} AS b, {_draw("c")} AS c, {_draw("d")} AS d, {_draw("j")} AS j FROM e, range((SELECT n FROM e))),
s AS (SELECT range, t, j, 0.3 * pow(1 - t, 2) AS base, abs({_SCALE} * sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b) / pow(greatest(abs(sqrt(-2 * ln(1 - c)) * cos(2 * pi() * d)), 1e-12), 1 / 1.5)) AS jump FROM d)
SELECT CAST(range AS INT) AS epoch, round(greatest(0.01, least(0.3, CASE WHEN t < 0.7 AND j < 0.12 THEN base * (1 + 0.08 * jump) ELSE base END)), 6) AS alpha FROM s"""

# the same results by other plans
SQL["tiled_components"] = SQL["connected_components"]
SQL["run_fill_holes"] = SQL["fill_holes"]
SQL["run_algebra"] = with_(PX, DENSE) + SQL["mask_algebra"][len(with_(PX)) :] + " UNION ALL SELECT image_id, y, x, 'neither' FROM dense WHERE NOT (v > 20 OR (v > 5 AND x % 2 = 0))"
SQL["merged_scaler"] = SQL["fit_scaler"]
SQL["scan_headers"] = SQL["scan_images"].split("UNION ALL")[0].replace("n_channels", "channels")
