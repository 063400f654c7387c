"""Queries over whole-volume operators that work by line, lattice vertex or point: dense CRF, cubic splines, elastic fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intensity as I
from ..operators import lattice as L
from ..operators import splines as Z
from . import runs as R
from .queries_runs import _FIVE, _PAIR, _shaped, _sides
from .queries_volume import SHAPE, VOX, K, rounded, vox
from .queries_windows import _S6, _border_join
from .registry import query
from .spec import read_config


def _e(number: float) -> str:
    """A literal that DuckDB reads as a double."""
    return f"{number!r}" if "e" in repr(number) else f"{number!r}e0"


def lattice_sql(name: str, points: str, ids: str, features: list[str]) -> str:
    """CTEs that end in <name>: ids, k0 .. k(d-1), weight: the vertices of each point, step by step in one order of sums."""
    d = len(features)
    n = d + 1
    tail = lambda j: " + ".join(f"c{i}" for i in reversed(range(j, d))) if j < d else "0e0"
    cte = lambda step, columns, from_: f"{name}_{step} AS MATERIALIZED (SELECT {ids}, {', '.join(columns)} FROM {from_})"
    before = lambda i, j: f"(r{j} {'>=' if j < i else '>'} r{i})::INT"
    step = lambda i: f"(CASE WHEN q{i} < 0 THEN 1 WHEN q{i} > {d} THEN -1 ELSE 0 END)"
    es = [f"e{j}" for j in range(n)]
    left = lambda r: "coalesce(" + ", ".join(f"CASE WHEN rank{i} = {r} THEN (e{i} - y{i}) / {n}e0 END" for i in range(n)) + ")"
    place = lambda k, i: f"'k{i}': (y{i} + CASE WHEN rank{i} <= {d - k} THEN {k} ELSE {k - n} END)::INT"
    vertices = [f"{{{', '.join(place(k, i) for i in range(d))}, 'weight': {f't{d - k} - t{d + 1 - k}' if k else f'1e0 + t{d} - t0'}}}" for k in range(n)]
    return ",\n".join([
        cte("c", [f"({f}) * {_e(s)} AS c{i}" for i, (f, s) in enumerate(zip(features, L.scales(d), strict=True))], points),
        cte("e", [f"({tail(j)}) - c{j - 1} * {j}e0 AS e{j}" if j else f"{tail(0)} AS e0" for j in range(n)], f"{name}_c"),
        cte("v", [*es, *[f"round_even(e{j} / {n}e0, 0)::INT AS v{j}" for j in range(n)]], f"{name}_e"),
        cte("r", [*es, *[f"v{j}" for j in range(n)], *[f"e{j} - v{j} * {n} AS r{j}" for j in range(n)], f"{' + '.join(f'v{j}' for j in range(n))} AS off"], f"{name}_v"),
        cte("q", [*es, *[f"v{j}" for j in range(n)], *[f"{' + '.join(before(i, j) for j in range(n) if j != i)} + off AS q{i}" for i in range(n)]], f"{name}_r"),
        cte("y", [*es, *[f"q{i} + {step(i)} * {n} AS rank{i}" for i in range(n)], *[f"(v{i} + {step(i)}) * {n} AS y{i}" for i in range(n)]], f"{name}_q"),
        cte("t", [*[f"y{i}" for i in range(d)], *[f"rank{i}" for i in range(d)], *[f"{left(r)} AS t{r}" for r in range(n)]], f"{name}_y"),
        f"{name} AS MATERIALIZED (SELECT {ids}, {', '.join(f'c.k{i}' for i in range(d))}, c.weight AS weight FROM (SELECT {ids}, unnest([{', '.join(vertices)}]) AS c FROM {name}_t))",
    ])


def filter_sql(name: str, lattice: str, values: str, key: str, ids: str, channels: list[str], d: int) -> str:
    """CTEs that end in <name>: ids and the channels of values, filtered: splat, d + 1 blurs, slice."""
    ks = [f"k{i}" for i in range(d)]
    out = [f"{name}_0 AS MATERIALIZED (SELECT {key}, {', '.join(ks)}, {', '.join(f'sum(weight * {c}) AS {c}' for c in channels)} FROM {lattice} JOIN {values} USING ({ids}) GROUP BY ALL)"]
    for j in range(d + 1):
        side = lambda t, s, j=j: f"LEFT JOIN {name}_{j} {t} ON {t}.{key} = v.{key} AND " + " AND ".join(f"{t}.k{i} = v.k{i} + {s * (d if i == j else -1)}" for i in range(d))
        sums = ", ".join(f"v.{c} + 0.5e0 * (coalesce(a.{c}, 0) + coalesce(b.{c}, 0)) AS {c}" for c in channels)
        out.append(f"{name}_{j + 1} AS MATERIALIZED (SELECT v.{key}, {', '.join(f'v.{k}' for k in ks)}, {sums} FROM {name}_{j} v {side('a', 1)} {side('b', -1)})")
    sums = ", ".join(f"sum(weight * {c}) / {_e(1 + 2.0**-d)} AS {c}" for c in channels)
    out.append(f"{name} AS MATERIALIZED (SELECT {ids}, {sums} FROM {lattice} JOIN {name}_{d + 1} USING ({key}, {', '.join(ks)}) GROUP BY ALL)")
    return ",\n".join(out)


_IDS = "vec_id, x, y, z"
_PLACE = {"a": ["z / 2e0", "y / 2e0", "x / 2e0", "value / 0.5e0"], "b": ["z / 1.5e0", "y / 1.5e0", "x / 1.5e0"]}


def crf_sql(rounds: int) -> str:
    """Mean-field rounds of two classes by the same lattice steps: logits value and -value / 2, feature value."""
    parts = [VOX, "u AS MATERIALIZED (SELECT vec_id, x, y, z, value, value AS u0, -0.5e0 * value AS u1, 1e0 AS one FROM vox)"]
    for k, features in _PLACE.items():
        parts += [lattice_sql(f"l{k}", "u", _IDS, features), filter_sql(f"n{k}", f"l{k}", "u", "vec_id", _IDS, ["one"], len(features))]
    parts.append(f"g AS MATERIALIZED (SELECT {_IDS}, u0, u1, 1e0 / sqrt(na.one + 1e-20) AS na, 1e0 / sqrt(nb.one + 1e-20) AS nb FROM u JOIN na USING ({_IDS}) JOIN nb USING ({_IDS}))")
    parts.append(f"h0 AS MATERIALIZED (SELECT {_IDS}, u0 AS h0, u1 AS h1 FROM u)")
    for t in range(rounds):
        q = "exp(h{0} - greatest(h0, h1)) / (exp(h0 - greatest(h0, h1)) + exp(h1 - greatest(h0, h1)))"
        for k, features in _PLACE.items():
            parts.append(f"s{t}{k} AS MATERIALIZED (SELECT {_IDS}, {q.format(0)} * n{k} AS m0, {q.format(1)} * n{k} AS m1 FROM h{t} JOIN g USING ({_IDS}))")
            parts.append(filter_sql(f"f{t}{k}", f"l{k}", f"s{t}{k}", "vec_id", _IDS, ["m0", "m1"], len(features)))
        new = ", ".join(f"u{i} + (a.m{i} * na + b.m{i} * nb) AS h{i}" for i in range(2))
        parts.append(f"h{t + 1} AS MATERIALIZED (SELECT {_IDS}, {new} FROM g JOIN f{t}a a USING ({_IDS}) JOIN f{t}b b USING ({_IDS}))")
    return f"WITH {', '.join(parts)} SELECT {_IDS}, round(h0, 6) + 0 AS foreground, round(h1, 6) + 0 AS background FROM h{rounds}"


@query(crf_sql(2))
def vox_crf(spark, d):
    """RS10: a dense CRF of two classes over each volume, by the permutohedral lattice."""
    rows = vox(spark, d).withColumn("foreground", F.col("value")).withColumn("background", -0.5 * F.col("value"))
    out = L.dense_crf(rows, ["vec_id"], ["foreground", "background"], ["value"], 2.0, 0.5, 1.5, 2)
    return out.select("vec_id", "x", "y", "z", *[(F.round(c, 6) + 0).alias(c) for c in ("foreground", "background")])


def spline_sql(name: str, n: int, to: int) -> str:
    """A CTE <name>(o, i, w): what voxel i of a line of n gives to place o of `to` on the cubic spline through the line.

    The weights come from the mirrored impulse response and the four basis functions, worked out by the engine itself.
    """
    mirror = lambda e, p=max(1, 2 * n - 2): f"(CASE WHEN (({e}) % {p} + {p}) % {p} < {n} THEN (({e}) % {p} + {p}) % {p} ELSE {p} - (({e}) % {p} + {p}) % {p} END)"
    basis = "CASE b WHEN -1 THEN pow(1 - t, 3) / 6 WHEN 0 THEN (3 * pow(t, 3) - 6 * pow(t, 2) + 4) / 6 WHEN 1 THEN (-3 * pow(t, 3) + 3 * pow(t, 2) + 3 * t + 1) / 6 ELSE pow(t, 3) / 6 END"
    return f"""{name} AS MATERIALIZED (SELECT o, {mirror(f"{mirror('base + b')} + k")}::INT AS i, sum({basis} * sqrt(3e0) * pow(sqrt(3e0) - 2, abs(k))) AS w
FROM (SELECT o, least(floor(o * {n - 1}e0 / {to - 1}), {n - 1})::INT AS base, o * {n - 1}e0 / {to - 1} - least(floor(o * {n - 1}e0 / {to - 1}), {n - 1}) AS t FROM range({to}) r(o)), range(-1, 3) s(b), range(-40, 41) u(k) GROUP BY ALL)"""


_ZOOM = f"""WITH {VOX}, {spline_sql("h", 4, 6)}, {spline_sql("g", 4, 3)}
SELECT vec_id, a.o::INT AS x, b.o::INT AS y, c.o::INT AS z, round(sum(a.w * b.w * c.w * value), 6) + 0 AS value FROM vox JOIN h a ON a.i = x JOIN g b ON b.i = y JOIN h c ON c.i = z GROUP BY vec_id, a.o, b.o, c.o"""


@query(_ZOOM)
def vox_zoom_cubic_uneven(spark, d):
    """F-A9: a cubic zoom between the voxels on all axes, growing two of them and shrinking one."""
    out = Z.zoom_cubic(vox(spark, d), K, SHAPE, (6, 3, 6))
    return out.select(*K, "x", "y", "z", (F.round("value", 6) + 0).alias("value"))


_CONTROLS, _SIGMA, _SEED = 3, 0.7, 5
_DRAW = "((floor(((((vec_id * 7919 + i * 104729 + {0}) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648 / 65536)) + 0.5) / 32768"
_ELASTIC = f"""WITH {VOX}, {spline_sql("h", _CONTROLS, 4)},
f AS MATERIALIZED (SELECT vec_id, i // {_CONTROLS**3} AS c, i // {_CONTROLS**2} % {_CONTROLS} AS fx, i // {_CONTROLS} % {_CONTROLS} AS fy, i % {_CONTROLS} AS fz,
    {_SIGMA}e0 * sqrt(-2 * ln({_DRAW.format(_SEED)})) * cos(2 * pi() * {_DRAW.format(1299709 + _SEED)}) AS v FROM (SELECT vec_id, unnest(range({3 * _CONTROLS**3})) AS i FROM embeddings)),
m AS (SELECT vec_id, a.o AS x, b.o AS y, e.o AS z, sum(a.w * b.w * e.w * v) FILTER (c = 0) AS dx, sum(a.w * b.w * e.w * v) FILTER (c = 1) AS dy, sum(a.w * b.w * e.w * v) FILTER (c = 2) AS dz
    FROM f JOIN h a ON a.i = fx JOIN h b ON b.i = fy JOIN h e ON e.i = fz GROUP BY ALL),
p AS (SELECT vec_id, x, y, z, least(greatest(x + dx, 0), 3) AS px, least(greatest(y + dy, 0), 3) AS py, least(greatest(z + dz, 0), 3) AS pz FROM m),
n AS (SELECT *, least(floor(px)::INT + i, 3) AS nx, least(floor(py)::INT + j, 3) AS ny, least(floor(pz)::INT + k, 3) AS nz,
    (CASE i WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) * (CASE j WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE k WHEN 1 THEN pz - floor(pz) ELSE 1 - pz + floor(pz) END) AS w
    FROM p, range(2) s(i), range(2) t(j), range(2) u(k))
SELECT n.vec_id, n.x::INT AS x, n.y::INT AS y, n.z::INT AS z, round(sum(w * value), 6) + 0 AS value FROM n JOIN vox v ON v.vec_id = n.vec_id AND v.x = nx AND v.y = ny AND v.z = nz GROUP BY ALL"""


@query(_ELASTIC)
def vox_elastic(spark, d):
    """F-A7: displacements drawn at three control places an axis, splined to the voxels, volumes sampled there."""
    v = vox(spark, d)
    out = Z.elastic(v, K, SHAPE, _CONTROLS, field=Z.portable_field(v, "vec_id", _CONTROLS, _SIGMA, _SEED))
    return rounded(out).withColumn("value", F.col("value") + 0)


def draw_sql(name: str, seed: int) -> str:
    """The draw in [0, 1) of a vec_id: an unsigned CRC-32 of key, name and seed, bit by bit, over 2 ** 32."""
    bits = f"flatten(list_transform(string_split(vec_id || ':{name}:{seed}', ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"(xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) / 4294967296e0)"


_PS = ", ".join(map(str, (0.01, *I.INNER, 0.99)))
_TAKE = ", ".join(str(i + 1) for i in I.LANDMARKS["percentile"])
_TURN = ["(cc * cb - sc * sa * sb) * {0} - sc * ca * {1} + (cc * sb + sc * sa * cb) * {2}", "(sc * cb + cc * sa * sb) * {0} + cc * ca * {1} + (sc * sb - cc * sa * cb) * {2}", "-ca * sb * {0} + sa * {1} + ca * cb * {2}"]
_OFF = [f"({a} - (g{i} - 1) / 2e0)" for i, a in enumerate("xyz")]
_CHAIN = f"""WITH {_FIVE},
k AS (SELECT vec_id, t, m, quantile_cont(value, [{_PS}]) AS a FROM vox GROUP BY ALL),
l AS (SELECT t, m, i, avg(coalesce(100e0 / nullif(a[13] - a[1], 0), 0) * (a[i] - a[1])) AS b FROM k, range(1, 14) r(i) GROUP BY ALL),
j AS (SELECT k.vec_id, k.t, k.m, list_select(a, [{_TAKE}]) AS a, list_select(b, [{_TAKE}]) AS b FROM k JOIN (SELECT t, m, list(b ORDER BY i) AS b FROM l GROUP BY ALL) USING (t, m)),
n AS (SELECT v.*, a, b, 1 + len(list_filter(a[2:10], lambda q: q <= value)) AS s0 FROM vox v JOIN j USING (vec_id, t, m)),
w AS (SELECT vec_id, t, m, x, y, z, s, b[s0] + coalesce((b[s0 + 1] - b[s0]) / nullif(a[s0 + 1] - a[s0], 0), 0) * (value - a[s0]) AS value FROM n),
u AS (SELECT vec_id, s, {", ".join(f"greatest(1, round_even(s[{i + 1}] * ((-30 + 80 * {draw_sql(f'scale{i}', 7)} + 100) / 100), 0))::BIGINT AS g{i}" for i in range(3))},
    {", ".join(f"radians(-20 + 40 * {draw_sql(f'angle{i}', 7)}) AS a{i}" for i in range(3))}, {draw_sql('flip0', 7)} < 0.5 AS f0, false AS f1, {draw_sql('flip2', 7)} < 0.5 AS f2 FROM e),
c AS (SELECT *, cos(a0) AS ca, sin(a0) AS sa, cos(a1) AS cb, sin(a1) AS sb, cos(a2) AS cc, sin(a2) AS sc FROM u),
d AS (SELECT *, unnest(range(g0)) AS x FROM c), d1 AS (SELECT *, unnest(range(g1)) AS y FROM d), d2 AS (SELECT *, unnest(range(g2)) AS z FROM d1),
q AS (SELECT vec_id, x, y, z, s, f0, f1, f2, g0, g1, g2, {", ".join(f"{r.format(*_OFF)} + (g{i} - 1) / 2e0 AS q{i}" for i, r in enumerate(_TURN))} FROM d2),
o AS (SELECT vec_id, x, y, z, s, {", ".join(f"CASE WHEN g{i} > 1 THEN (s[{i + 1}] - 1e0) / (g{i} - 1) ELSE 0 END * q{i} * CASE WHEN f{i} THEN -1 ELSE 1 END + CASE WHEN f{i} THEN s[{i + 1}] - 1 ELSE 0 END AS p{i}" for i in range(3))} FROM q),
h AS (SELECT vec_id, x, y, z, {", ".join(f"least(greatest(floor(p{i}) + o{i}, 0), s[{i + 1}] - 1) AS n{i}" for i in range(3))}, {" * ".join(f"(CASE o{i} WHEN 1 THEN p{i} - floor(p{i}) ELSE 1 - p{i} + floor(p{i}) END)" for i in range(3))} AS wt
    FROM o, range(2) r0(o0), range(2) r1(o1), range(2) r2(o2))
SELECT h.vec_id, w.t, w.m, h.x::INT AS x, h.y::INT AS y, h.z::INT AS z, round(sum(wt * value), 5) + 0 AS value FROM h JOIN w ON w.vec_id = h.vec_id AND w.x = n0 AND w.y = n1 AND w.z = n2 GROUP BY ALL"""


@query(_CHAIN)
def run_training_chain(spark, d):
    """Histogram normalisation by time point and modality, then flips, scaling and rotation drawn for each volume, as one
    sampling; volumes of four shapes, cut by the sampler of whole images."""
    unit = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    packed = _shaped(spark, d).withColumns({"affine": unit, "pixdim": F.array(*[F.lit(1.0)] * 3)})
    spec = read_config("""[image]
path_to_search = /nowhere
[NETWORK]
normalisation = True
[TRAINING]
random_flipping_axes = 0,2
scaling_percentage = -30,50
antialiasing = False
rotation_angle = -20,20""")
    out = R.run_chain(spec, packed, "image", "vec_id", seed=7)
    return out.select("vec_id", "t", "m", "x", "y", "z", (F.round("value", 5) + 0).alias("value"))


@R.CENTRES.register("brightest")
def brightest(vox, images, key, window, samples):
    """Centres on the largest values of each volume, the first place of equals."""
    first = Window.partitionBy(key).orderBy(F.desc("value"), "x", "y", "z")
    return vox.withColumn("draw", F.row_number().over(first) - 1).where(F.col("draw") < samples).select(key, "draw", "x", "y", "z")


@query(f"""WITH {VOX}, c AS (SELECT vec_id, x, y, z, (row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, x, y, z) - 1)::INT AS draw FROM vox),
w AS (SELECT vec_id, draw, greatest(least(x - 1, 1), 0) AS x0, 0 AS y0, greatest(least(z - 1, 2), 0) AS z0 FROM c WHERE draw < 2)
SELECT w.vec_id, draw, i::INT AS x, j::INT AS y, k::INT AS z, coalesce(value, 0) AS value FROM w CROSS JOIN range(3) a(i) CROSS JOIN range(5) b(j) CROSS JOIN range(2) c(k)
LEFT JOIN vox v ON v.vec_id = w.vec_id AND v.x = x0 + i AND v.y = y0 + j AND v.z = z0 + k""")
def run_own_centres(spark, d):
    """A centre generator of one's own in a run; windows of 3 x 5 x 2 are moved inside and padded along y."""
    spec = read_config("[NETWORK]\nwindow_sampling = brightest\n[TRAINING]\nsample_per_volume = 2")
    return R.run_training_windows(spec, vox(spark, d), (3, 5, 2), SHAPE, "vec_id").select("vec_id", "draw", "x", "y", "z", "value")


@R.METRICS.register("mean_border_distance")
@R.needs("border_distances")
def _mean_distance(vox, keys, border_distances):
    return border_distances.groupBy(*keys).agg(F.avg("distance").alias("mean_border_distance"))


@R.METRICS.register("far_border_share")
@R.needs("border_distances", "borders")
def _far_share(vox, keys, border_distances, borders):
    far = border_distances.groupBy(*keys).agg(F.count_if(F.col("distance") > 1).alias("far"))
    return borders.groupBy(*keys).agg(F.count("*").alias("n")).join(far, keys).select(*keys, (F.col("far") / F.col("n")).alias("far_border_share"))


@R.METRICS.register("wrong_share")
@R.needs("confusion")
def _wrong_share(vox, keys, confusion):
    wrong = F.col("fp") + F.col("fn")
    return confusion.select(*keys, (wrong / (wrong + F.col("tp") + F.col("tn"))).alias("wrong_share"))


@query(f"""WITH {_PAIR}, m AS (SELECT vec_id, x, y, z, s AS seg, r AS ref FROM j), {_S6}, {_border_join('seg')}, {_border_join('ref')},
d AS (SELECT a.vec_id, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d FROM bseg a JOIN bref b USING (vec_id) GROUP BY a.vec_id, a.x, a.y, a.z
    UNION ALL SELECT a.vec_id, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) FROM bref a JOIN bseg b USING (vec_id) GROUP BY a.vec_id, a.x, a.y, a.z),
e AS (SELECT vec_id, avg(d) AS mean_border_distance, count(*) FILTER (d > 1) AS far FROM d GROUP BY 1), n AS (SELECT vec_id, count(*) AS n FROM (SELECT * FROM bseg UNION ALL SELECT * FROM bref) GROUP BY 1),
c AS (SELECT vec_id, count(*) FILTER (s AND r) AS tp, count(*) FILTER (s <> r) AS w, count(*) AS a FROM j GROUP BY 1)
SELECT vec_id, round(2 * tp / nullif(2 * tp + w, 0), 6) AS dice, round(tp / nullif(tp + w, 0), 6) AS jaccard, round(mean_border_distance, 6) AS mean_border_distance, round(far / n, 6) AS far_border_share, round(w / a, 6) AS wrong_share
FROM c LEFT JOIN e USING (vec_id) LEFT JOIN n USING (vec_id)""")
def run_own_metrics(spark, d):
    """Metrics of one's own beside others; borders, distances and confusion are made once for all of them."""
    names = ("dice", "jaccard", "mean_border_distance", "far_border_share", "wrong_share")
    spec = read_config(f"[EVALUATION]\nevaluations = {', '.join(names)}\n[SEGMENTATION]\nevaluation_units = foreground")
    out = R.run_evaluation(spec, "segmentation", *_sides(spark, d), key="vec_id")["vec_id",]
    return out.select("vec_id", *[F.round(n, 6).alias(n) for n in names])
