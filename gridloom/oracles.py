"""DuckDB SQL with the same rows as the queries, written from the operators' definitions.

A stencil joins every pixel to its neighbours by folded coordinates, with the kernel as a list of
values; nothing here shares code with the operators.
"""

from __future__ import annotations

from math import exp, pi, sqrt

SUPPLIER_WEEKS = """px AS (
    SELECT g.d0, g.d1, coalesce(s.v, 0)::DOUBLE AS v
    FROM (SELECT a.d0, b.d1 FROM (SELECT s_suppkey::BIGINT AS d0 FROM supplier) a
          CROSS JOIN (SELECT unnest(generate_series(0, 357))::BIGINT AS d1) b) g
    LEFT JOIN (SELECT l_suppkey::BIGINT AS d0, (date_diff('day', DATE '1995-01-02', l_shipdate::DATE) // 7)::BIGINT AS d1, sum(l_quantity) AS v
               FROM lineitem GROUP BY ALL) s USING (d0, d1))"""

PART_DAYS = """size AS (SELECT floor(10 * sqrt(count(*)))::BIGINT AS side FROM supplier), px AS (
    SELECT g.d0, g.d1, coalesce(s.v, 0)::DOUBLE AS v
    FROM (SELECT a.d0, b.d1 FROM (SELECT unnest(generate_series(0, side - 1))::BIGINT AS d0 FROM size) a
          CROSS JOIN (SELECT unnest(generate_series(0, side - 1))::BIGINT AS d1 FROM size) b) g
    LEFT JOIN (SELECT (l_partkey % side)::BIGINT AS d0, (dayofyear(l_shipdate) % side)::BIGINT AS d1, count(*) AS v FROM lineitem CROSS JOIN size GROUP BY ALL) s USING (d0, d1))"""

LABELLED = SUPPLIER_WEEKS + """,
    lx AS (SELECT *, CASE WHEN v > 50 THEN 1 + d1 % 16 ELSE 0 END AS lab FROM px),
    ix AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 99])::BIGINT AS label)"""


def _measured(select: str, default: str) -> str:
    return f"WITH {LABELLED}, m AS (SELECT lab, {select} AS r FROM lx GROUP BY lab) SELECT ix.label, coalesce(m.r, {default}) AS r FROM ix LEFT JOIN m ON m.lab = ix.label"


def _first(order: str, prefix: str) -> str:
    return f"{prefix} AS (SELECT lab, v, d0, d1 FROM (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY {order}, d0, d1) AS k FROM lx) WHERE k = 1)"


def _position(order: str) -> str:
    return f"WITH {LABELLED}, {_first(order, 'm')} SELECT ix.label, coalesce(m.d0, 0) AS pos0, coalesce(m.d1, 0) AS pos1 FROM ix LEFT JOIN m ON m.lab = ix.label"


def _fold(i: str, n: str) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"


def _stencil(px: str, taps: list[tuple], select: str) -> str:
    """Columns of a tap: a, b (offsets), w0, w1, ..."""
    names = ", ".join(["a", "b", *(f"w{j}" for j in range(len(taps[0]) - 2))])
    values = ", ".join("(" + ", ".join(repr(x) for x in tap) + ")" for tap in taps)
    return f"""WITH {px}, n AS (SELECT max(d0) + 1 AS n0, max(d1) + 1 AS n1 FROM px), k({names}) AS (VALUES {values}),
        t AS MATERIALIZED (SELECT px.d0, px.d1, k.*, {_fold('px.d0 + k.a', 'n0')} AS q0, {_fold('px.d1 + k.b', 'n1')} AS q1 FROM px CROSS JOIN k CROSS JOIN n)
        SELECT t.d0, t.d1, {select} AS r FROM t JOIN px q ON q.d0 = t.q0 AND q.d1 = t.q1 GROUP BY t.d0, t.d1"""


BOX = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
CROSS = [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
ASYMMETRIC = [(a, b, w) for (a, b), w in zip(BOX, [1, 2, 0, -1, 3, 1, 0, -2, 4])]
# Convolution: out[i] = sum w[k] in[i - k + size // 2 + origin], size (2, 3), origin (0, 1).
WIDE = [(-p + 1, -q + 2, w) for p, row in enumerate([[1, -2, 3], [0, 4, -1]]) for q, w in enumerate(row)]

_Z = sum(exp(-x * x / 2) for x in range(-2, 3))
_G = {0: lambda x: exp(-x * x / 2) / _Z, 1: lambda x: x * exp(-x * x / 2) / _Z, 2: lambda x: (x * x - 1) * exp(-x * x / 2) / _Z}


def _gaussian(*orders: tuple[int, int]) -> list[tuple]:
    return [(a, b, *(_G[p](a) * _G[q](b) for p, q in orders)) for a in range(-2, 3) for b in range(-2, 3)]


def _counted(threshold: str) -> str:
    return f"SELECT d0, sum((v > round(r, 6))::BIGINT)::BIGINT AS n FROM (SELECT px.d0, px.v, s.r FROM px JOIN ({threshold}) s USING (d0, d1)) GROUP BY d0"


def _above(taps: list[tuple], select: str) -> str:
    inner = _stencil("px AS (SELECT * FROM px0)", taps, select)
    return f"WITH px0 AS (WITH {SUPPLIER_WEEKS} SELECT * FROM px), px AS (SELECT * FROM px0) " + _counted(inner)


_T = exp(-4.5)  # sigma 1/3 at distance one
_GT = [(a, b, (_T ** abs(a)) * (_T ** abs(b)) / (1 + 2 * _T) ** 2) for a, b in BOX]


def _morph(steps: list[str]) -> str:
    parts = [SUPPLIER_WEEKS, "s0 AS (SELECT d0, d1, v > 40 AS b FROM px)", "k(a, c) AS (VALUES (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0))"]
    for j, step in enumerate(steps):
        parts.append(f"s{j + 1} AS (SELECT t.d0, t.d1, {step}(coalesce(q.b, false)) AS b FROM s{j} t CROSS JOIN k LEFT JOIN s{j} q ON q.d0 = t.d0 + k.a AND q.d1 = t.d1 + k.c GROUP BY t.d0, t.d1)")
    return f"WITH {', '.join(parts)} SELECT d0, d1, b::BIGINT AS r FROM s{len(steps)}"


def _components(wrap: bool) -> str:
    to = "(r.d1 + k.b + 358) % 358" if wrap else "r.d1 + k.b"
    return f"""WITH RECURSIVE {SUPPLIER_WEEKS}, fg AS (SELECT d0, d1, d0 * 358 + d1 AS pos FROM px WHERE v > 90),
        k(a, b) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
        reach(d0, d1, root) AS (SELECT d0, d1, pos FROM fg UNION SELECT q.d0, q.d1, r.root FROM reach r CROSS JOIN k JOIN fg q ON q.d0 = r.d0 + k.a AND q.d1 = {to}),
        least AS (SELECT d0, d1, min(root) AS root FROM reach GROUP BY d0, d1)
        SELECT d0, d1, dense_rank() OVER (ORDER BY root)::BIGINT AS label FROM least"""


def _f(d: str) -> str:
    return f"(CASE WHEN {d} < (side + 1) // 2 THEN {d} ELSE {d} - side END / side::DOUBLE)"


def _sinc(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 1.0 ELSE sin({x}) / {x} END)"


_ANGLE = f"(-2 * {pi!r} * (1.5 * {_f('d0')} - 2 * {_f('d1')}))"


def _linear(points: str, keys: str) -> str:
    """Order 1 at points (keys, x0, x1) of the square raster; zero outside."""
    return f"""p AS ({points}), c AS (SELECT p.*, floor(x0)::BIGINT AS i, floor(x1)::BIGINT AS j FROM p CROSS JOIN size WHERE x0 BETWEEN 0 AND side - 1 AND x1 BETWEEN 0 AND side - 1),
        k(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
        m AS (SELECT {keys}, sum(px.v * (1 - abs(c.x0 - (c.i + k.a))) * (1 - abs(c.x1 - (c.j + k.b)))) AS r
              FROM c CROSS JOIN k JOIN px ON px.d0 = c.i + k.a AND px.d1 = c.j + k.b GROUP BY {keys})"""


ORACLE_SQL = {
    "measure_area": _measured("count(*)", "0"),
    "measure_sum_labels": _measured("round(sum(v), 6)", "0"),
    "measure_sum": _measured("round(sum(v), 6)", "0"),
    "measure_mean": _measured("round(avg(v), 6)", "NULL"),
    "measure_median": _measured("round(median(v), 6)", "NULL"),
    "measure_minimum": _measured("round(min(v), 6)", "0"),
    "measure_maximum": _measured("round(max(v), 6)", "0"),
    "measure_variance": _measured("round(var_pop(v), 6)", "NULL"),
    "measure_standard_deviation": _measured("round(stddev_pop(v), 6)", "NULL"),
    "measure_minimum_position": _position("v"),
    "measure_maximum_position": _position("v DESC"),
    "measure_extrema": f"""WITH {LABELLED}, {_first('v', 'lo')}, {_first('v DESC', 'hi')}
        SELECT ix.label, coalesce(lo.v, 0)::BIGINT AS minimum, coalesce(hi.v, 0)::BIGINT AS maximum, coalesce(lo.d0, 0) AS min_pos0, coalesce(lo.d1, 0) AS min_pos1, coalesce(hi.d0, 0) AS max_pos0, coalesce(hi.d1, 0) AS max_pos1
        FROM ix LEFT JOIN lo ON lo.lab = ix.label LEFT JOIN hi ON hi.lab = ix.label""",
    "measure_center_of_mass": f"""WITH {LABELLED}, m AS (SELECT lab, round(sum(v * d0) / sum(v), 6) AS com0, round(sum(v * d1) / sum(v), 6) AS com1 FROM lx GROUP BY lab)
        SELECT ix.label, m.com0, m.com1 FROM ix LEFT JOIN m ON m.lab = ix.label""",
    "measure_histogram": f"""WITH {LABELLED}, h AS (SELECT lab, CASE WHEN v = 330 THEN 10 ELSE floor(v / 30)::BIGINT END AS bin, count(*) AS n FROM lx WHERE v BETWEEN 0 AND 330 GROUP BY ALL),
        b AS (SELECT DISTINCT lab AS label FROM lx WHERE lab > 0)
        SELECT b.label::BIGINT AS label, g.bin::BIGINT AS bin, coalesce(h.n, 0)::BIGINT AS n FROM b CROSS JOIN (SELECT unnest(generate_series(0, 10)) AS bin) g LEFT JOIN h ON h.lab = b.label AND h.bin = g.bin""",
    "measure_labeled_comprehension": _measured("(max(v) - min(v))::BIGINT", "-1"),
    "measure_find_objects": f"WITH {LABELLED} SELECT lab::BIGINT AS label, min(d0) AS start0, max(d0) + 1 AS stop0, min(d1) AS start1, max(d1) + 1 AS stop1 FROM lx WHERE lab <> 0 GROUP BY lab",
    "measure_label": _components(False),
    "measure_label_wrap": _components(True),
    "filter_correlate": _stencil(SUPPLIER_WEEKS, ASYMMETRIC, "sum(t.w0 * q.v)::BIGINT"),
    "filter_convolve": _stencil(SUPPLIER_WEEKS, WIDE, "sum(t.w0 * q.v)::BIGINT"),
    "filter_laplace": _stencil(SUPPLIER_WEEKS, [(a, b, -4 if (a, b) == (0, 0) else 1) for a, b in CROSS], "sum(t.w0 * q.v)::BIGINT"),
    "filter_sobel": _stencil(SUPPLIER_WEEKS, [(a, b, a * (2 - abs(b))) for a, b in BOX], "sum(t.w0 * q.v)::BIGINT"),
    "filter_prewitt": _stencil(SUPPLIER_WEEKS, [(a, b, b) for a, b in BOX], "sum(t.w0 * q.v)::BIGINT"),
    "filter_uniform": _stencil(SUPPLIER_WEEKS, BOX, "round(sum(q.v) / 9, 6)"),
    "filter_gaussian": _stencil(PART_DAYS, _gaussian((0, 0)), "round(sum(t.w0 * q.v), 6)"),
    "filter_gaussian_filter": _stencil(PART_DAYS, _gaussian((0, 1)), "round(sum(t.w0 * q.v), 6)"),
    "filter_gaussian_gradient_magnitude": _stencil(PART_DAYS, _gaussian((1, 0), (0, 1)), "round(sqrt(sum(t.w0 * q.v) ** 2 + sum(t.w1 * q.v) ** 2), 6)"),
    "filter_gaussian_laplace": _stencil(PART_DAYS, _gaussian((2, 0), (0, 2)), "round(sum((t.w0 + t.w1) * q.v), 6)"),
    "filter_minimum": _stencil(SUPPLIER_WEEKS, BOX, "min(q.v)::BIGINT"),
    "filter_maximum": _stencil(SUPPLIER_WEEKS, CROSS, "max(q.v)::BIGINT"),
    "filter_median": _stencil(SUPPLIER_WEEKS, BOX, "list_sort(list(q.v))[5]::BIGINT"),
    "filter_median_wide": _stencil(PART_DAYS, [(a, b) for a in range(-3, 4) for b in range(-3, 4)], "list_sort(list(q.v))[25]::BIGINT"),
    "filter_median_sliding": _stencil(SUPPLIER_WEEKS, [(a, b) for a in range(-8, 9) for b in range(-8, 9)], "list_sort(list(q.v))[145]::BIGINT"),
    "filter_uniform_frames": _stencil(SUPPLIER_WEEKS, [(a, b) for a in range(-7, 8) for b in range(-7, 8)], "round(sum(q.v) / 225, 6)"),
    "filter_maximum_frames": _stencil(SUPPLIER_WEEKS, [(a, b) for a in range(-7, 8) for b in range(-7, 8)], "max(q.v)::BIGINT"),
    "filter_rank": _stencil(SUPPLIER_WEEKS, CROSS, "list_sort(list(q.v))[2]::BIGINT"),
    "filter_percentile": _stencil(SUPPLIER_WEEKS, BOX, "list_sort(list(q.v))[3]::BIGINT"),
    "filter_generic": _stencil(SUPPLIER_WEEKS, BOX, "sum(q.v * q.v)::BIGINT"),
    "filter_generic_vectorized": _stencil(SUPPLIER_WEEKS, BOX, "(max(greatest(q.v, 25)) - min(greatest(q.v, 25)))::BIGINT"),
    "filter_threshold_local_gaussian": _above(_GT, "sum(t.w0 * q.v)"),
    "filter_threshold_local_mean": _above(BOX, "sum(q.v) / 9"),
    "filter_threshold_local_median": _above(BOX, "list_sort(list(q.v))[5]"),
    "filter_threshold_local_generic": _above(BOX, "max(q.v) / 2"),
    "morph_erosion": _morph(["bool_and"]),
    "morph_dilation": _morph(["bool_or"]),
    "morph_opening": _morph(["bool_and", "bool_or"]),
    "morph_closing": _morph(["bool_or", "bool_and"]),
    "fourier_gaussian": f"WITH {PART_DAYS} SELECT d0, d1, round(v * exp(-0.5 * (2 * {pi!r}) ** 2 * ({_f('d0')} ** 2 + {_f('d1')} ** 2)), 6) AS r FROM px CROSS JOIN size",
    "fourier_uniform": f"WITH {PART_DAYS} SELECT d0, d1, round(v * {_sinc(f'(2 * {pi!r} * {_f('d0')})')} * {_sinc(f'(2 * {pi!r} * {_f('d1')})')}, 6) AS r FROM px CROSS JOIN size",
    "fourier_shift": f"WITH {PART_DAYS} SELECT d0, d1, round(v * cos({_ANGLE}), 6) AS re, round(v * sin({_ANGLE}), 6) AS im FROM px CROSS JOIN size",
    "interp_affine_transform": f"WITH {PART_DAYS}, {_linear('SELECT d0, d1, d0 + 0.25 * d1 + 2 AS x0, -0.25 * d0 + d1 + 8 AS x1 FROM px', 'c.d0, c.d1')} SELECT px.d0, px.d1, round(coalesce(m.r, 0), 6) AS r FROM px LEFT JOIN m USING (d0, d1)",
    "interp_rotate": f"WITH {PART_DAYS} SELECT side - 1 - d1 AS d0, d0 AS d1, v::BIGINT AS r FROM px CROSS JOIN size",
    "interp_map_coordinates": f"WITH {PART_DAYS}, {_linear('SELECT event_id AS point_id, (event_id % (4 * side)) * 0.25::DOUBLE AS x0, (user_id % (2 * side)) * 0.5::DOUBLE AS x1 FROM events CROSS JOIN size', 'c.point_id')} SELECT p.point_id, round(coalesce(m.r, 0), 6)::DOUBLE AS r FROM p LEFT JOIN m USING (point_id)",
}


def _cubic(points: str) -> str:
    """Samples at x0, x1 of points (d0, d1) by the cubic B-spline over the mirrored image; zero outside."""
    weight = "CASE WHEN {t} < 1 THEN 2.0 / 3 - {t} ** 2 + {t} ** 3 / 2 WHEN {t} < 2 THEN (2 - {t}) ** 3 / 6 ELSE 0 END"
    fold = "CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > side - 1 THEN 2 * side - 2 - ({i}) ELSE {i} END"
    axis = [f"(floor(x{k})::BIGINT + {t})" for k, t in ((0, "a"), (1, "b"))]
    cells = ", ".join(f"({a}, {b})" for a in range(-1, 3) for b in range(-1, 3))
    return f"""p AS ({points}), k(a, b) AS (VALUES {cells}),
        t AS (SELECT d0, d1, {fold.format(i=axis[0])} AS q0, {fold.format(i=axis[1])} AS q1, {weight.format(t=f'abs(x0 - {axis[0]})')} * {weight.format(t=f'abs(x1 - {axis[1]})')} AS w
              FROM p CROSS JOIN k CROSS JOIN size WHERE x0 BETWEEN 0 AND side - 1 AND x1 BETWEEN 0 AND side - 1),
        m AS (SELECT t.d0, t.d1, sum(t.w * px.v) AS r FROM t JOIN px ON px.d0 = t.q0 AND px.d1 = t.q1 GROUP BY t.d0, t.d1)"""


# A spline's coefficients: the image against sums of powers of the pole, on the mirrored line.
_POLE = sqrt(3) - 2


def _coefficients(source: str, axis: int) -> str:
    other, at = 1 - axis, f"(s.d{axis} + k.n)"
    fold = f"CASE WHEN {at} < 0 THEN -{at} WHEN {at} > side - 1 THEN 2 * side - 2 - {at} ELSE {at} END"
    return f"SELECT s.d0, s.d1, sum(k.w * q.v) AS v FROM {source} s CROSS JOIN size CROSS JOIN k JOIN {source} q ON q.d{other} = s.d{other} AND q.d{axis} = {fold} GROUP BY s.d0, s.d1"


_POWERS = f"k AS (SELECT n::BIGINT AS n, {-6 * _POLE / (1 - _POLE**2)!r} * ({_POLE!r}) ** abs(n) AS w FROM (SELECT unnest(generate_series(-48, 48)) AS n))"
_TURN, _HALF = sqrt(3) / 2, 0.5
_ROTATED = f"""SELECT i AS d0, j AS d1, {_TURN!r}::DOUBLE * i + {_HALF!r}::DOUBLE * j + (side - 1) / 2.0::DOUBLE - {_TURN + _HALF!r}::DOUBLE * (grown - 1) / 2 AS x0,
           {-_HALF!r}::DOUBLE * i + {_TURN!r}::DOUBLE * j + (side - 1) / 2.0::DOUBLE - {_TURN - _HALF!r}::DOUBLE * (grown - 1) / 2 AS x1
    FROM (SELECT side, floor(side * {_TURN + _HALF!r}::DOUBLE + 0.5)::BIGINT AS grown, unnest(generate_series(0, floor(side * {_TURN + _HALF!r}::DOUBLE + 0.5)::BIGINT - 1))::BIGINT AS i FROM size)
    CROSS JOIN (SELECT unnest(generate_series(0, floor(side * {_TURN + _HALF!r}::DOUBLE + 0.5)::BIGINT - 1))::BIGINT AS j FROM size)"""

ORACLE_SQL |= {
    "interp_affine_transform_cubic": f"WITH {PART_DAYS}, {_cubic('SELECT d0, d1, 0.93::DOUBLE * d0 + 0.237::DOUBLE * d1 + 2.31::DOUBLE AS x0, -0.211::DOUBLE * d0 + 1.013::DOUBLE * d1 + 7.93::DOUBLE AS x1 FROM px')} SELECT px.d0, px.d1, round(coalesce(m.r, 0), 6) AS r FROM px LEFT JOIN m USING (d0, d1)",
    "interp_rotate_30": f"WITH {PART_DAYS}, {_linear(_ROTATED, 'c.d0, c.d1')} SELECT p.d0, p.d1, round(coalesce(m.r, 0), 6) AS r FROM p LEFT JOIN m USING (d0, d1)",
    "interp_spline_filter1d": f"WITH {PART_DAYS}, {_POWERS} SELECT d0, d1, round(v, 6) AS r FROM ({_coefficients('px', 0)})",
    "interp_spline_filter": f"WITH {PART_DAYS}, {_POWERS}, f AS MATERIALIZED ({_coefficients('px', 0)}) SELECT d0, d1, round(v, 6) AS r FROM ({_coefficients('f', 1)})",
}


SUPPLIER_LINES = """px AS MATERIALIZED (
    SELECT g.d0, g.d1, g.d2, coalesce(s.v, 0)::DOUBLE AS v
    FROM (SELECT a.d0, b.d1, c.d2 FROM (SELECT s_suppkey::BIGINT AS d0 FROM supplier) a CROSS JOIN (SELECT unnest(generate_series(0, 6))::BIGINT AS d1) b CROSS JOIN (SELECT unnest(generate_series(0, 83))::BIGINT AS d2) c) g
    LEFT JOIN (SELECT l_suppkey::BIGINT AS d0, l_linenumber::BIGINT - 1 AS d1, (12 * (year(l_shipdate) - 1995) + month(l_shipdate) - 1)::BIGINT AS d2, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) s USING (d0, d1, d2)),
    n AS (SELECT max(d0) + 1 AS n0, max(d1) + 1 AS n1, max(d2) + 1 AS n2 FROM px)"""


def _along(source: str, axis: int, size: int, agg: str, fold: str) -> str:
    """``agg`` of ``size`` values along an axis of a volume; ``fold`` of a place {i} and a size {n} stands for one outside."""
    others = " AND ".join(f"q.d{k} = s.d{k}" for k in range(3) if k != axis)
    at = fold.format(i=f"(s.d{axis} + k.a)", n=f"n{axis}")
    return f"""SELECT s.d0, s.d1, s.d2, {agg}(q.v) AS v FROM {source} s CROSS JOIN n CROSS JOIN (SELECT unnest(generate_series({-(size // 2)}, {size - 1 - size // 2}))::BIGINT AS a) k
        JOIN {source} q ON {others} AND q.d{axis} = {at} GROUP BY ALL"""


def _volume(passes: list[tuple[int, int, str, str]], select: str) -> str:
    parts, last = [SUPPLIER_LINES], "px"
    for k, (axis, size, agg, fold) in enumerate(passes):
        parts.append(f"v{k} AS MATERIALIZED ({_along(last, axis, size, agg, fold)})")
        last = f"v{k}"
    return f"WITH {', '.join(parts)} SELECT d0, d1, d2, {select} AS r FROM {last}"


_REFLECT, _WRAP, _NEAREST = _fold("{i}", "{n}"), "(({i} % {n}) + {n}) % {n}", "greatest(0, least({i}, {n} - 1))"
_DIAMOND = "SELECT a, b FROM (SELECT unnest(generate_series(-20, 20))::BIGINT AS a) CROSS JOIN (SELECT unnest(generate_series(-20, 20))::BIGINT AS b) WHERE abs(a) + abs(b) <= 20"

ORACLE_SQL |= {
    "filter_uniform_volume": _volume([(0, 21, "avg", _REFLECT), (1, 5, "avg", _REFLECT), (2, 41, "avg", _REFLECT)], "round(v, 6)"),
    "io_imread": f"WITH {SUPPLIER_LINES} SELECT d0, d1, d2, v::BIGINT AS r FROM px",
    "io_imread_files": f"WITH {SUPPLIER_LINES} SELECT d0, d1, d2, v::BIGINT AS r FROM px",
    "filter_range_volume": _volume([(0, 15, "max", _WRAP), (1, 3, "max", _WRAP), (2, 31, "max", _WRAP), (0, 21, "min", _NEAREST), (2, 9, "min", _NEAREST)], "v::BIGINT"),
    # out[i] = any in[i - k + size // 2 + origin]: 15 and 9 places up and down of the shifted centre.
    "morph_dilation_wide": f"""WITH {SUPPLIER_WEEKS}, k(a, b) AS (SELECT a, b FROM (SELECT unnest(generate_series(-5, 9))::BIGINT AS a) CROSS JOIN (SELECT unnest(generate_series(-5, 3))::BIGINT AS b)),
        hit AS (SELECT DISTINCT px.d0 - k.a AS d0, px.d1 - k.b AS d1 FROM px CROSS JOIN k WHERE px.v > 120)
        SELECT px.d0, px.d1, (hit.d0 IS NOT NULL)::BIGINT AS r FROM px LEFT JOIN hit USING (d0, d1)""",
    # Twenty steps of a cross reach as far as 20 along both axes together; only pixels of the image clear others.
    "morph_erosion_iterated": f"""WITH {SUPPLIER_WEEKS}, k(a, b) AS ({_DIAMOND}), hit AS (SELECT DISTINCT px.d0 + k.a AS d0, px.d1 + k.b AS d1 FROM px CROSS JOIN k WHERE NOT px.v < 150)
        SELECT px.d0, px.d1, (hit.d0 IS NULL)::BIGINT AS r FROM px LEFT JOIN hit USING (d0, d1)""",
}


def _plain_zeros(sql: str, columns: tuple[str, ...]) -> str:
    """Turns a negative zero into zero."""
    plain = ", ".join(f"CASE WHEN {c} = 0 THEN 0::DOUBLE ELSE {c} END AS {c}" for c in columns)
    return f"SELECT * REPLACE ({plain}) FROM ({sql})"


ORACLE_SQL |= {k: _plain_zeros(v, ("re", "im") if k == "fourier_shift" else ("r",)) for k, v in ORACLE_SQL.items() if k.startswith(("filter_gaussian", "filter_uniform", "fourier_", "interp_affine", "interp_map", "interp_rotate_30", "interp_spline"))}
