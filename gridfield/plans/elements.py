"""More queries over the driver's tables: parts of grids, field operators, elements, duals, transport, files, lanes."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfield.field import Field
from gridfield.functions import algebra as A
from gridfield.functions import lanes
from gridfield.lattice import Lattice
from gridfield.operators import gauge, stencils
from gridfield.operators.gauge import Gauge
from gridfield.plans import fixtures as X
from gridfield.plans.registry import _C, _DET, _F, _LANES, _PLAQ, _TA, _U, BOX, UNIT, E, _lane_sql, _long, _neighbour_sql, _psi, back, moved, query, r, rounded
from gridfield.sources import lime, scidac

# --- 1. parts of grids ----------------------------------------------------------------------------------------------
PARTS = Lattice((8, 8, 8, 16), (2, 1, 2, 4))
_PROCESS, _LOCAL = "(((x0 // 4) + x1 // 8) * 2 + x2 // 4) * 4 + x3 // 4", "(((x0 % 4) * 8 + x1 % 8) * 4 + x2 % 4) * 4 + x3 % 4"


@query(f"SELECT site, {_PROCESS} AS process, {_LOCAL} AS local, site AS back FROM ({_C})")
def lattice_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.col("site")
    rows = PARTS.sites(spark).select("site", PARTS.process_of(site).alias("process"), PARTS.local_index(site).alias("local"))
    return rows.select("*", PARTS.global_index(F.col("process"), F.col("local")).alias("back"))


@query("SELECT p AS process, p // 8 * 4 AS low0, p // 8 * 4 + 3 AS high0, 0 AS low1, 7 AS high1, p // 4 % 2 * 4 AS low2, p // 4 % 2 * 4 + 3 AS high2, p % 4 * 4 AS low3, p % 4 * 4 + 3 AS high3 FROM (SELECT unnest(range(16)) AS p)")
def lattice_bounds(spark, sf_dir):
    names = [f"{side}{d}" for d in range(4) for side in ("low", "high")]
    rows = [(p, *(x for pair in zip(*PARTS.bounds(p), strict=True) for x in pair)) for p in range(PARTS.processes().volume)]
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in ["process", *names]))


@query(f"SELECT site, x0, x1 + 8 AS g1, x3 - 4 AS l3 FROM ({_C}) WHERE x3 >= 4")
def lattice_offsets(spark, sf_dir):
    """Coordinates to those of a whole grid and of a part, by the part's first coordinates."""
    rows, xs = PARTS.sites(spark).where("x3 >= 4"), [F.col(f"x{d}") for d in range(4)]
    up, down = PARTS.global_coordinates(xs, (0, 8, 0, 0)), PARTS.local_coordinates(xs, (0, 0, 0, 4))
    return rows.select("site", up[0].alias("x0"), up[1].alias("g1"), down[3].alias("l3"))


@query("SELECT k, CASE WHEN a BETWEEN 1 AND 3 AND b BETWEEN 2 AND 5 THEN ((a - 1) * 4 + b - 2) * 5 + c END AS site FROM (SELECT k, k // 40 AS a, k // 5 % 8 AS b, k % 5 AS c FROM (SELECT unnest(range(200)) AS k))")
def lattice_unpadded(spark, sf_dir):
    lat = Lattice((3, 4, 5), (), (1, 2, 0))
    return spark.range(200).select(F.col("id").alias("k"), lat.unpadded(F.col("id")).alias("site"))


_SMALL = "SELECT unnest(range(60)) AS site"
SMALL = Lattice((3, 4, 5))


@query(f"SELECT site, k, CASE WHEN k = 0 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS v FROM ({_SMALL}), (SELECT unnest([0, 1]) AS k)")
def field_filled(spark, sf_dir):
    """A field of zeros, with one element of its vectors set."""
    return Field.filled(spark, SMALL, (2,)).set_element((0,), 2.5).long()


@query(f"SELECT site, CASE WHEN site // 20 <= 1 AND site % 5 IN (4, 0) THEN -1.0::DOUBLE ELSE site::DOUBLE END AS v FROM ({_SMALL})")
def field_patch(spark, sf_dir):
    """A patch that wraps in the last dimension, read and put back as another value."""
    f = Field(SMALL, SMALL.sites(spark).select("site", F.col("site").cast("double").alias("v")))
    return f.put(f.patch((0, 0, 4), (1, 3, 5)).select("site", F.lit(-1.0).alias("v"))).df


# --- 2. scalar fields -----------------------------------------------------------------------------------------------
def _joined(*fields: tuple[str, Field]) -> DataFrame:
    """Fields of one lattice side by side, each rounded."""
    out = None
    for name, f in fields:
        columns = [F.col("v.re").alias(f"{name}_re"), F.col("v.im").alias(f"{name}_im")] if f.complex else [F.col("v").alias(name)]
        own = f.df.select("site", *columns)
        out = own if out is None else out.join(own, "site")
    return rounded(out, *out.columns[1:])


_X = "SELECT o_orderkey AS site, o_totalprice AS v, o_totalprice / 100000 AS x FROM orders"


@query(f"SELECT site, round(v / (v + 1), 6) AS by_field, round(v / 2.5, 6) AS by_number, round(1000 / v, 6) AS of_number, round(7 - v, 6) AS taken, round(-v * 2 + 1, 6) AS linear FROM ({_X})")
def field_arithmetic(spark, sf_dir):
    f = X.prices(spark, sf_dir)
    return _joined(("by_field", f / (f + 1.0)), ("by_number", f / 2.5), ("of_number", 1000.0 / f), ("taken", 7.0 - f), ("linear", 1.0 + 2.0 * -f))


@query(f"SELECT site, {', '.join(f'round({n}(x), 6) + 0.0 AS {n}' for n in ('exp', 'cos', 'tan', 'sinh', 'cosh', 'tanh'))}, round(abs(1 - sqrt(x)), 6) + 0.0 AS modulus FROM ({_X})")
def field_elementary(spark, sf_dir):
    x = X.prices(spark, sf_dir) / 100000.0
    return _joined(*((n, x.call(n)) for n in ("exp", "cos", "tan", "sinh", "cosh", "tanh")), ("modulus", (1.0 - x.call("sqrt")).abs()))


@query(f"SELECT site, round(pow(x, 2), 6) AS square, round(pow(2, x), 6) AS base, round(pow(x, x), 6) AS both FROM ({_X})")
def field_powers(spark, sf_dir):
    x = X.prices(spark, sf_dir) / 100000.0
    return _joined(("square", x**2), ("base", 2.0**x), ("both", x**x))


_OPS = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


@query(f"SELECT site, {', '.join(f'v {op} 150000 AS n_{n}, v {op} greatest(v, 150000) AS f_{n}' for n, op in _OPS.items())} FROM ({_X})")
def field_comparisons(spark, sf_dir):
    f = X.prices(spark, sf_dir)
    other, out = f.map(lambda a: F.greatest(a, F.lit(150000.0))), f.df.select("site")
    for n, op in _OPS.items():
        out = out.join(f.compare(op, 150000.0).withColumnRenamed("is", f"n_{n}"), "site").join(f.compare(op, other).withColumnRenamed("is", f"f_{n}"), "site")
    return out


_Z = f"{E}, z AS (SELECT site, e[1] AS a, e[2] AS b, e[3] AS c, e[4] AS d FROM e)"


@query(f"{_Z} SELECT site, {r('a')} AS re, {r('b')} AS im, {r('a * a + b * b')} AS n2, {r('sqrt(a * a + b * b)')} AS n, {r('a')} AS conj_re, {r('-b')} AS conj_im, {r('a')} AS up_re, 0.0::DOUBLE AS up_im, {r('a + 2')} AS more_re, {r('b + 1')} AS more_im, abs(a) >= 0 AND a = a AS same FROM z")
def complex_parts(spark, sf_dir):
    z = X.complex_(spark, sf_dir, 0, ())
    out = _joined(("re", z.re()), ("im", z.im()), ("n2", z.norm2()), ("n", z.norm()), ("conj", z.adjoint()), ("up", z.re().to_complex()), ("more", z + A.Complex(2.0, 1.0)))
    return out.join(z.compare("==", z.map(lambda a: a.conj().conj())).withColumnRenamed("is", "same"), "site")


_MOD, _ARG = "sqrt(a * a + b * b)", "atan2(b, a)"


@query(f"{_Z} SELECT site, {r('exp(a) * cos(b)')} AS exp_re, {r('exp(a) * sin(b)')} AS exp_im, {r(f'ln({_MOD})')} AS ln_re, {r(_ARG)} AS ln_im, {r(f'sqrt({_MOD}) * cos({_ARG} / 2)')} AS sqrt_re, {r(f'sqrt({_MOD}) * sin({_ARG} / 2)')} AS sqrt_im, {r('sin(a) * cosh(b)')} AS sin_re, {r('cos(a) * sinh(b)')} AS sin_im, {r(f'pow({_MOD}, 1.5) * cos(1.5 * {_ARG})')} AS pow_re, {r(f'pow({_MOD}, 1.5) * sin(1.5 * {_ARG})')} AS pow_im FROM z")
def complex_functions(spark, sf_dir):
    z = X.complex_(spark, sf_dir, 0, ())
    return _joined(*((n, z.call(n)) for n in ("exp", "ln", "sqrt", "sin")), ("pow", z**1.5))


# --- 3. elements, vectors, matrices ---------------------------------------------------------------------------------
@query(f"{E} SELECT site, {r('e[6]')} AS second_row, {r('e[9]')} AS last, CASE WHEN site < 100 THEN -7.0::DOUBLE ELSE {r('e[2]')} END AS written, {r('e[2] + e[10]')} AS added FROM e")
def matrix_elements(spark, sf_dir):
    m = X.real(spark, sf_dir, 0, (3, 3))
    written = m.set_element((0, 1), -7.0, F.col("site") < 100).element(0, 1)
    added = m.set_element((0, 1), m.element(0, 1) + X.real(spark, sf_dir, 9, ())).element(0, 1)
    return _joined(("second_row", m.element(1, 2)), ("last", m.element(2, 2)), ("written", written), ("added", added))


@query(f"{E} SELECT site, k, CASE WHEN k = 23 THEN 1.0::DOUBLE ELSE {r('e[k + 1]')} END AS v, {r('e[24]')} AS old FROM e, (SELECT unnest(range(24))::INTEGER AS k)")
def cube_elements(spark, sf_dir):
    """Rank 3: element (i, j, k) of 2 x 3 x 4 is number (i * 3 + j) * 4 + k."""
    f = X.real(spark, sf_dir, 0, (2, 3, 4))
    written = rounded(f.set_element((1, 2, 3), 1.0).long(), "v")
    return written.join(rounded(f.element(1, 2, 3).df.withColumnRenamed("v", "old"), "old"), "site")


@query(f"{E} SELECT site, k, CASE WHEN site % 2 = 0 THEN 5.0::DOUBLE ELSE {r('e[k + 1]')} END AS filled, CASE WHEN site % 2 = 0 THEN {r('e[k + 4]')} ELSE {r('e[k + 1]')} END AS copied FROM e, (SELECT unnest([0, 1, 2]) AS k)")
def field_assign(spark, sf_dir):
    a, b, even = X.real(spark, sf_dir, 0, (3,)), X.real(spark, sf_dir, 3, (3,)), F.col("site") % 2 == 0
    filled, copied = a.assign(5.0, even).long().withColumnRenamed("v", "filled"), a.assign(b, even).long().withColumnRenamed("v", "copied")
    return rounded(filled.join(copied, ["site", "k"]), "filled", "copied")


@query(f"{E} SELECT site, {r('e[1]')} AS v, '[[1.0, 0.0], [0.0, ' || CASE WHEN site % 2 = 0 THEN '2.0' ELSE '1.0' END || ']]' AS text FROM e")
def field_text(spark, sf_dir):
    """A vector of one element as a scalar, and values as text."""
    f = X.real(spark, sf_dir, 0, (1,)).squeeze()
    one = Field.filled(spark, f.lattice, (2, 2)).assign(0.0).set_element((0, 0), 1.0).set_element((1, 1), 1.0).set_element((1, 1), 2.0, F.col("site") % 2 == 0)
    return rounded(f.df, "v").join(one.text(), "site")


@query(f"{E} SELECT site, {r('e[1] * e[7] + e[2] * e[8] + e[3] * e[9] + e[4] * e[10] + e[5] * e[11] + e[6] * e[12]')} AS dot_re, {r('e[1] * e[8] - e[2] * e[7] + e[3] * e[10] - e[4] * e[9] + e[5] * e[12] - e[6] * e[11]')} AS dot_im, {r('e[1] * e[7] - e[2] * e[8]')} AS outer_re, {r('e[1] * e[8] + e[2] * e[7]')} AS outer_im, {r('-e[4]')} AS conj_im FROM e")
def complex_vectors(spark, sf_dir):
    """dot conjugates its first vector, the outer product none."""
    a, b = X.complex_(spark, sf_dir, 0, (3,)), X.complex_(spark, sf_dir, 6, (3,))
    return _joined(("dot", a.dot(b)), ("outer", a.outer(b).element(0, 0)), ("conj_im", a.conjugate().element(1).im()))


@query(f"{E} SELECT site, k, {r('(e[k + 1] + e[k + 10]) * 2 - e[k + 1] / 4')} AS linear, {r('e[k + 1] + 3')} AS plus, {r('e[k + 1] * e[20]')} AS scaled, {r('-e[k + 1] / (e[20] * e[20] + 1)')} AS divided FROM e, (SELECT unnest(range(9))::INTEGER AS k)")
def matrix_arithmetic(spark, sf_dir):
    a, b, s = X.real(spark, sf_dir, 0, (3, 3)), X.real(spark, sf_dir, 9, (3, 3)), X.real(spark, sf_dir, 19, ())
    made = {"linear": (a + b) * 2.0 - a / 4.0, "plus": a + 3.0, "scaled": s * a, "divided": -a / (s * s + 1.0)}
    out = None
    for name, f in made.items():
        own = f.long().withColumnRenamed("v", name)
        out = own if out is None else out.join(own, ["site", "k"])
    return rounded(out, *made)


@query(f"{E} SELECT site, k, {r('e[2 * k + 1] + 1')} AS plus_re, {r('e[2 * k + 2] - 2')} AS plus_im, {r('e[2 * k + 1] * e[20] - e[2 * k + 2] * e[21]')} AS scaled_re, {r('e[2 * k + 1] * e[21] + e[2 * k + 2] * e[20]')} AS scaled_im FROM e, (SELECT unnest(range(9))::INTEGER AS k)")
def complex_matrix_arithmetic(spark, sf_dir):
    """Complex matrices with a complex number added to each element, and times a complex scalar field."""
    a, s = X.complex_(spark, sf_dir, 0, (3, 3)), X.complex_(spark, sf_dir, 19, ())
    plus, scaled = ((f.long().select("site", "k", F.col("re").alias(f"{n}_re"), F.col("im").alias(f"{n}_im"))) for n, f in (("plus", a + A.Complex(1.0, -2.0)), ("scaled", s * a)))
    out = plus.join(scaled, ["site", "k"])
    return rounded(out, *out.columns[2:])


def _det_sql(n: int, rows=None, columns=None) -> str:
    """A sum over permutations of a minor's elements."""
    rows, columns = rows or range(n), columns or range(n)
    terms = []
    for p in permutations(range(len(rows))):
        odd = sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2
        terms.append(("-" if odd else "+") + " * ".join(f"e[{n * rows[i] + columns[p[i]] + 1}]" for i in range(len(p))))
    return f"({' '.join(terms)})"


def _adjugate_sql(n: int, i: int, j: int) -> str:
    rest = lambda k: [x for x in range(n) if x != k]
    return f"{'-' if (i + j) % 2 else ''}{_det_sql(n, rest(j), rest(i))}"


@query(f"{E} SELECT site, {', '.join(f'{r(_det_sql(n), 9)} AS d{n}' for n in (1, 2, 4))} FROM e")
def determinants(spark, sf_dir):
    out = None
    for n in (1, 2, 4):
        own = rounded(X.real(spark, sf_dir, 0, (n, n)).determinant().df, "v", digits=9).withColumnRenamed("v", f"d{n}")
        out = own if out is None else out.join(own, "site")
    return out


@query(f"{E} SELECT site, unnest(range(16))::INTEGER AS k, unnest([{', '.join(r(_adjugate_sql(4, i, j), 9) for i in range(4) for j in range(4))}]) AS v, unnest([1.0::DOUBLE, {r('e[4]', 9)}, {r('-e[2]', 9)}, {r('-e[3]', 9)}, {r('e[1]', 9)}, {', '.join(['0.0::DOUBLE'] * 11)}]) AS small FROM e")
def adjugates(spark, sf_dir):
    """Of 4 x 4 matrices; beside it those of 1 x 1 and 2 x 2 ones, one after the other."""
    large = rounded(X.real(spark, sf_dir, 0, (4, 4)).adjugate().long(), "v", digits=9)
    one, two = X.real(spark, sf_dir, 0, (1, 1)).adjugate(), X.real(spark, sf_dir, 0, (2, 2)).adjugate()
    both = one.with_([two], lambda a, b: A.flatten(a) + A.flatten(b) + [F.lit(0.0)] * 11, (16,)).long().withColumnRenamed("v", "small")
    return large.join(rounded(both, "small", digits=9), ["site", "k"])


@query(f"{E} SELECT site, 3 * i + j AS k, {r('e[2 * (3 * j + i) + 1]')} AS o, {r('e[2 * (3 * j + i) + 1]')} AS su_re, {r('-e[2 * (3 * j + i) + 2]')} AS su_im FROM e, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)")
def group_inverses(spark, sf_dir):
    """Matrices of orthogonal groups are inverted by transposing, those of unitary ones by the adjoint."""
    z = X.complex_(spark, sf_dir, 0, (3, 3))
    o = Field(z.lattice, z.re().df, (3, 3), False, "SO").inverse().long().withColumnRenamed("v", "o")
    su = Field(z.lattice, z.df, (3, 3), True, "SU").inverse().long().select("site", "k", F.col("re").alias("su_re"), F.col("im").alias("su_im"))
    return rounded(o.join(su, ["site", "k"]), "o", "su_re", "su_im")


# --- 4. dual numbers ------------------------------------------------------------------------------------------------
_P = "SELECT p_partkey, p_retailprice / 1000 AS x FROM part"


@query(f"SELECT p_partkey, round(5 - x, 6) AS minus, -3.0::DOUBLE AS minus_du, round(x / 2, 6) AS half, 1.5::DOUBLE AS half_du, round(x, 6) AS adj, -3.0::DOUBLE AS adj_du, round(x * x, 6) AS n2, round(6 * x, 6) AS n2_du, -3.0::DOUBLE AS abs_du, true AS same, x = 1 AS other FROM ({_P})")
def dual_arithmetic(spark, sf_dir):
    x = A.Dual(F.col("p_retailprice") / 1000, 3.0)
    made = {"minus": 5.0 - x, "half": x / 2.0, "adj": x.adj(), "n2": x.norm2(), "abs": (-x).abs() * -1.0}
    columns = {c: v for n, d in made.items() for c, v in ((n, d.re), (f"{n}_du", d.du)) if c != "abs"}
    rows = X.table(spark, sf_dir, "part").select("p_partkey", *(v.alias(c) for c, v in columns.items()), (x == x.conjugate()).alias("same"), (x == A.Dual(1.0, 3.0)).alias("other"))
    return rounded(rows, *columns)


@query(f"SELECT p_partkey, {', '.join(f'round({v}, 6) + 0.0 AS {n}' for n, v in dict(cos='-sin(x)', tan='1 / (cos(x) * cos(x))', sinh='cosh(x)', cosh='sinh(x)', ln='1 / x', sin='cos(x)').items())} FROM ({_P})")
def dual_derivatives(spark, sf_dir):
    """The derivative parts of elementary functions, the number's own being one."""
    x, names = A.Dual(F.col("p_retailprice") / 1000), ("cos", "tan", "sinh", "cosh", "ln", "sin")
    return rounded(X.table(spark, sf_dir, "part").select("p_partkey", *(getattr(x, n)().du.alias(n) for n in names)), *names)


def _times(p: str, q: str) -> tuple[str, str]:
    (a, b), (c, d) = ((f"{x}re", f"{x}im") for x in (p, q))
    return f"({a} * {c} - {b} * {d})", f"({a} * {d} + {b} * {c})"


_W = f"{E}, w AS (SELECT site, e[1] AS wre, e[2] AS wim, e[3] AS ure, e[4] AS uim, e[5] AS yre, e[6] AS yim, exp(e[1]) * cos(e[2]) AS xre, exp(e[1]) * sin(e[2]) AS xim FROM e)"
_ED = _times("x", "u")


@query(f"{_W} SELECT site, {r('xre')} AS exp_re, {r('xim')} AS exp_im, {r(_ED[0])} AS exp_dre, {r(_ED[1])} AS exp_dim, {r(_times('w', 'y')[0])} AS mul_re, {r(_times('w', 'y')[1])} AS mul_im, {r(_times('u', 'y')[0] + ' + wre')} AS mul_dre, {r(_times('u', 'y')[1] + ' + wim')} AS mul_dim, {r('wre * wre + wim * wim')} AS n2_re, {r('2 * (wre * ure + wim * uim)')} AS n2_dre, {r('-ure')} AS adj_dre, {r('uim')} AS adj_dim FROM w")
def complex_duals(spark, sf_dir):
    """exp(w), w y with y's derivative one, w conj(w), and the adjoint, of complex dual numbers."""
    lat, rows = X.vectors(spark, sf_dir)
    z = lambda k: A.Complex(X.element(k), X.element(k + 1))
    w = A.Dual(z(0), z(2))
    e, m, n, a = w.exp(), w * A.Dual(z(4), A.Complex(1.0)), w.norm2(), w.adj()
    columns = {"exp_re": e.re.re, "exp_im": e.re.im, "exp_dre": e.du.re, "exp_dim": e.du.im, "mul_re": m.re.re, "mul_im": m.re.im, "mul_dre": m.du.re, "mul_dim": m.du.im, "n2_re": n.re.re, "n2_dre": n.du.re, "adj_dre": a.du.re, "adj_dim": a.du.im}
    return rounded(rows.select("site", *(v.alias(c) for c, v in columns.items())), *columns)


# --- 5. neighbours, links -------------------------------------------------------------------------------------------
_BOX6 = Lattice((5, 5, 4, 6))


@query(_neighbour_sql(list(UNIT)) + " UNION ALL " + _neighbour_sql([back(u) for u in UNIT]).replace(" AS point", " + 4 AS point"))
def stencil_one_way(spark, sf_dir):
    ahead, behind = (stencils.neighbours(spark, _BOX6, p(_BOX6)) for p in (stencils.forward, stencils.backward))
    return ahead.unionByName(behind.withColumn("point", F.col("point") + 4))


@query(f"SELECT site, {moved('6', UNIT[1])} AS ahead, {moved('6', back(UNIT[1]))} AS behind, {moved('6', (1, 0, -1, 0))} AS corner FROM (SELECT unnest(range(600)) AS site)")
def stencil_points(spark, sf_dir):
    """Neighbours picked by the number of a step's point, and of a corner's."""
    rows = stencils.neighbours(spark, _BOX6, stencils.staple(_BOX6))
    points = {"ahead": stencils.hop_point(1), "behind": stencils.hop_point(1, -1), "corner": stencils.corner_point(_BOX6, 2, -1, 0, 1)}
    out = None
    for name, k in points.items():
        own = rows.where(F.col("point") == k).select("site", F.col("neighbour").alias(name))
        out = own if out is None else out.join(own, "site")
    return out


@query(f"SELECT site, {moved('6', (0, 0, 3, 0))} AS source, (site // 6) % 4 < 1 AS local, (site // 6) % 4 < 3 AS sent FROM (SELECT unnest(range(600)) AS site)")
def shift_sets(spark, sf_dir):
    return stencils.shift_sets(spark, _BOX6, 2, 3)


def _moved_m(offset) -> str:
    """Matrices of e[33..40] as rows (site, i, j, re, im), moved."""
    return f"(SELECT {moved('n', back(offset), 'e.site')} AS site, i, j, e[33 + 4 * i + 2 * j] AS re, e[34 + 4 * i + 2 * j] AS im FROM e, n, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))"


@query(f"{_U} SELECT u.site, 2 * u.i + s.j AS k, {r('sum(u.re * s.re - u.im * s.im)', 9)} AS re, {r('sum(u.re * s.im + u.im * s.re)', 9)} AS im FROM u JOIN {_moved_m(UNIT[0])} s ON u.site = s.site AND u.j = s.i AND u.m = 0 GROUP BY ALL")
def transport_matrix(spark, sf_dir):
    return _long(X.links(spark, sf_dir).transport(X.complex_(spark, sf_dir, 32, (2, 2)), 0), digits=9)


@query(f"{_U}, p AS (SELECT u.site, u.j AS i, s.j AS j, sum(u.re * s.re + u.im * s.im) AS re, sum(u.re * s.im - u.im * s.re) AS im FROM u JOIN {_moved_m((0, 0, 0, 0))} s ON u.site = s.site AND u.i = s.i AND u.m = 1 GROUP BY ALL) SELECT {moved('n', UNIT[1], 'p.site')} AS site, 2 * i + j AS k, {r('re', 9)} AS re, {r('im', 9)} AS im FROM p, n")
def transport_matrix_backward(spark, sf_dir):
    return _long(X.links(spark, sf_dir).transport(X.complex_(spark, sf_dir, 32, (2, 2)), 1, -1), digits=9)


_PSI = "psi AS (SELECT site, i, e[33 + 2 * i] AS re, e[34 + 2 * i] AS im FROM e, (SELECT unnest([0, 1]) AS i))"
_AHEAD = f"ahead AS (SELECT u.site, u.i AS k, sum(u.re * s.re - u.im * s.im) AS re, sum(u.re * s.im + u.im * s.re) AS im FROM u JOIN (SELECT {moved('n', back(UNIT[3]))} AS site, i, re, im FROM psi, n) s ON u.site = s.site AND u.j = s.i AND u.m = 3 GROUP BY ALL)"
_BEHIND = f"behind AS (SELECT {moved('n', UNIT[3], 'u.site')} AS site, u.j AS k, sum(u.re * s.re + u.im * s.im) AS re, sum(u.re * s.im - u.im * s.re) AS im FROM u JOIN psi s ON u.site = s.site AND u.i = s.i AND u.m = 3 CROSS JOIN n GROUP BY ALL)"


@query(f"{_U}, {_PSI}, {_AHEAD}, {_BEHIND} SELECT a.site, a.k, {r('a.re - p.re')} AS fwd_re, {r('a.im - p.im')} AS fwd_im, {r('p.re - b.re')} AS bwd_re, {r('p.im - b.im')} AS bwd_im, {r('(a.re - b.re) / 2')} AS sym_re, {r('(a.im - b.im) / 2')} AS sym_im FROM ahead a JOIN behind b ON a.site = b.site AND a.k = b.k JOIN psi p ON p.site = a.site AND p.i = a.k")
def covariant_derivative(spark, sf_dir):
    g, psi, out = X.links(spark, sf_dir), _psi(spark, sf_dir), None
    for name, kind in (("fwd", "forward"), ("bwd", "backward"), ("sym", "symmetric")):
        own = g.covariant_derivative(psi, 3, kind).select("site", F.posexplode("v").alias("k", "z")).select("site", "k", F.col("z.re").alias(f"{name}_re"), F.col("z.im").alias(f"{name}_im"))
        out = own if out is None else out.join(own, ["site", "k"])
    return rounded(out, *out.columns[2:])


@query(f"{_U} SELECT u.site, u.i * 2 + u.j AS k, {r('re', 9)} AS re, {r('im', 9)} AS im FROM u WHERE m = 2")
def link_field(spark, sf_dir):
    """One direction of links that were put together from fields."""
    return _long(Gauge.of_fields([X.links(spark, sf_dir).field(mu) for mu in range(4)]).field(2), digits=9)


# --- 6. files -------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey AS site, o_totalprice AS v FROM orders")
def scidac_ranges(spark, sf_dir):
    """One file read by many tasks, a range of sites each."""
    path = X.shared_file(spark, "ranges.lime")
    scidac.write_field(X.prices(spark, sf_dir), path)
    return scidac.read_field(spark, path, block=4096).df


@query(f"{_U}{_F}{_TA} SELECT unnest(['linkTrace', 'plaquette']) AS quantity, unnest([(SELECT {r('sum(re) / (8 * count(DISTINCT site))', 9)} FROM u WHERE i = j), {r(f'{_PLAQ} / (6 * 2 * 100 * (SELECT n FROM n))', 9)}]) AS computed, true AS agrees")
def gauge_file_check(spark, sf_dir):
    """Plaquette and link trace of a file's links, held against what its user record says."""
    path = X.shared_file(spark, "gauge.lime")
    scidac.write_gauge(X.links(spark, sf_dir), path)
    return rounded(scidac.check_links(spark, path).drop("stored"), "computed", digits=9)


@query("SELECT 0 AS number, '5 5 4 ' || (SELECT count(*) // 100 FROM embeddings) AS dims, 'QDP_D2_ColorMatrix' AS datatype, 'D' AS precision, 2 AS colors, 0 AS spins, 64 AS typesize, 4 AS datacount, 256 * (SELECT count(*) FROM embeddings) AS bytes, true AS told")
def scidac_metadata(spark, sf_dir):
    path = X.shared_file(spark, "told.lime")
    scidac.write_gauge(X.links(spark, sf_dir), path, extra="<note>x</note>")
    rows = scidac.metadata(spark, path)
    return rows.select("number", F.array_join(F.col("dims").cast("array<string>"), " ").alias("dims"), "datatype", "precision", "colors", "spins", "typesize", "datacount", "bytes", (F.col("user").contains("<plaquette>") & F.col("suma").isNotNull()).alias("told"))


@query(f"{E} SELECT site, k, {r('e[2 * k + 1]')} AS re, {r('e[2 * k + 2]')} AS im FROM e, (SELECT unnest(range(16))::INTEGER AS k)")
def propagator_round_trip(spark, sf_dir):
    """Shape [2, 2, 2, 2] in a file of propagators."""
    path = X.shared_file(spark, "propagator.lime")
    scidac.write_qio(X.complex_(spark, sf_dir, 0, (2, 2, 2, 2)), path, spins=2)
    return _long(scidac.read_qio(spark, path))


@query("SELECT unnest(['a note', '']) AS text, unnest([6, 0]) AS length, unnest([0, 1]) AS number")
def lime_texts(spark, sf_dir):
    path = X.shared_file(spark, "texts.lime")
    lime.write(spark, path, [(lime.Record("note", 6, True, False), [b"a note"]), (lime.Record("empty", 0, False, True), [])])
    return spark.createDataFrame([(lime.content(spark, path, h).decode(), h.length, k) for k, h in enumerate(lime.headers(spark, path))], "text string, length int, number int")


# --- 7. lanes -------------------------------------------------------------------------------------------------------
def _coords(c: str) -> str:
    return f"{c} // 1024 AS x0, ({c} // 128) % 8 AS x1, ({c} // 16) % 8 AS x2, {c} % 16 AS x3"


@query(f"SELECT site, {_lane_sql('//')} AS grp, {_lane_sql('%')} AS lane FROM (SELECT site, {_coords('next')} FROM (SELECT site, x0 * 1024 + x1 * 128 + x2 * 16 + (x3 + 1) % 16 AS next FROM ({_C})))")
def lane_neighbours(spark, sf_dir):
    """Group and lane of the next site in the last dimension."""
    group, lane = _LANES.place(F.col("site"))
    rows = BOX.sites(spark).select("site", group.alias("g"), lane.alias("l"))
    to_group, to_lane = _LANES.neighbour(F.col("g"), F.col("l"), UNIT[3])
    return rows.select("site", to_group.alias("grp"), to_lane.alias("lane"))


@query(f"SELECT {_lane_sql('//')} AS grp, round(exp(sum(ln(1 + site / 10000.0::DOUBLE))), 9) AS product, round(sum(2.0::DOUBLE * site * site + 3), 6) AS fused, (sum(site) * 2)::DOUBLE AS doubled, max(CASE WHEN {_lane_sql('%')} = 1 THEN site END)::DOUBLE AS second, max(CASE WHEN {_lane_sql('%')} = 3 THEN site END)::DOUBLE AS fourth FROM ({_C}) GROUP BY ALL")
def lane_arithmetic(spark, sf_dir):
    held = _LANES.to_lanes(BOX.sites(spark).select("site", F.col("site").cast("double").alias("v")))
    v, n = F.col("v"), _LANES.lanes.volume
    twice = lanes.by_lane(lambda a, b: a + b, v, v)
    picked = lanes.strided(v, 1, 2, 2)
    fused = lanes.lane_sum(lanes.madd(lanes.by_lane(lambda a, b: a * b, lanes.splat(2.0, n), v), v, lanes.splat(3.0, n)))
    product = lanes.lane_product(F.transform(v, lambda x: 1 + x / 10000.0))
    out = held.select(F.col("group").alias("grp"), product.alias("product"), fused.alias("fused"), lanes.lane_sum(twice).alias("doubled"), F.get(picked, F.lit(0)).alias("second"), F.get(picked, F.lit(1)).alias("fourth"))
    return rounded(rounded(out, "product", digits=9), "fused")


@query(f"SELECT site, k, ({_lane_sql('//')}) * 24 + k * 8 + {_lane_sql('%')} AS at FROM ({_C}), (SELECT unnest(range(3)) AS k)")
def lane_array_index(spark, sf_dir):
    """Three elements a site."""
    group, lane = _LANES.place(F.col("site"))
    rows = BOX.sites(spark).select("site", group.alias("g"), lane.alias("l"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("k"))
    return rows.select("site", "k", _LANES.array_index(F.col("g"), F.col("l"), F.col("k"), 3).alias("at"))


# --- 8. metadata ----------------------------------------------------------------------------------------------------
_SHAPES = {(): False, (3,): True, (3, 3): True, (2, 3, 4): False}


@query("SELECT * FROM (VALUES ('scalar', 0, 1, 60, 1, 3, 1), ('vector', 1, 3, 60, 6, 20, 5), ('matrix', 2, 9, 60, 18, 100, 25), ('tensor', 3, 24, 60, 24, 360, 112)) AS v(kind, rank, elements, sites, numbers, block, first)")
def field_geometry(spark, sf_dir):
    """Sizes of fields, and of their blocks with a border of one."""
    fields = [Field(SMALL, None, shape, complex_) for shape, complex_ in _SHAPES.items()]
    rows = [(f.kind, len(f.shape), f.elements, f.lattice.volume, f.numbers, f.padded_block(1), f.padded_offset(1)) for f in fields]
    return spark.createDataFrame(rows, "kind string, rank int, elements int, sites int, numbers int, block int, first int")


@query("SELECT kind, n AS numbers, 4 * n AS single, 8 * n AS double, 512 * 4 * 8 * n AS bytes FROM (VALUES ('real', 1), ('complex', 2), ('color_vector', 6), ('color_matrix', 18), ('dirac_spinor', 24), ('propagator', 288)) AS v(kind, n)")
def scidac_sizes(spark, sf_dir):
    """Bytes of kinds of data, and of four of each on 4 x 4 x 4 x 8 sites."""
    lat, rows = Lattice((4, 4, 4, 8)), []
    for kind, n in scidac.TYPE_SIZES.items():
        rows.append((kind, n, scidac.default_info(kind, "F").typesize, scidac.default_info(kind).typesize, scidac.data_size(lat, scidac.default_info(kind, "D", 4))))
    return spark.createDataFrame(rows, "kind string, numbers int, single int, double int, bytes int")


@query("SELECT 1.0::DOUBLE AS link_trace, 1.0::DOUBLE AS plaquette, 0.0::DOUBLE AS action")
def unit_links(spark, sf_dir):
    g = Gauge.unit(spark, Lattice((3, 2, 2, 4)), 3)
    return rounded(g.link_trace().crossJoin(g.plaquette()).crossJoin(g.action(7.5, 1.0, -0.05)), "link_trace", "plaquette", "action")


@query("SELECT nc, nc * nc * (8 * nc - 2) AS product, 2 * nc * nc AS addition, 2 * (nc - 1) AS trace, nc * nc AS adjoint FROM (SELECT unnest(range(1, 6)) AS nc)")
def operation_counts(spark, sf_dir):
    rows = [(n, gauge.matmul_flops(n), gauge.add_flops(n), gauge.trace_flops(n), gauge.adjoint_flops(n)) for n in range(1, 6)]
    return spark.createDataFrame(rows, "nc long, product long, addition long, trace long, adjoint long")


@query(_neighbour_sql([s for d in range(4) for s in (UNIT[d], back(UNIT[d]))]))
def stencil_laplacian(spark, sf_dir):
    return stencils.neighbours(spark, _BOX6, stencils.laplacian(_BOX6))
