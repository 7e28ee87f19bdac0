"""Queries over the driver's tables (array form), and the same in SQL (long form: unnested elements and self-joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfield.field import Field
from gridfield.functions import algebra as A
from gridfield.functions import lanes, seeds, siteops
from gridfield.lattice import Lattice
from gridfield.operators import dense, stencils
from gridfield.plans import fixtures as X
from gridfield.sources import lime, scidac

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Rounded, and -0.0 as 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


# --- SQL pieces -----------------------------------------------------------------------------------------------------
N = {"e": "(SELECT count(*) // 100 FROM embeddings)", "o": "(SELECT count(*) // 100 FROM orders)"}
E = "WITH e AS (SELECT vec_id AS site, embedding::DOUBLE[] AS e FROM embeddings)"


def r(x: str, digits: int = DIGITS) -> str:
    return f"round({x}, {digits}) + 0.0"


def xs(n: str, site: str = "site") -> list[str]:
    return [f"({site} // (20 * {n}))", f"(({site} // (4 * {n})) % 5)", f"(({site} // {n}) % 4)", f"({site} % {n})"]


def moved(n: str, offset: tuple[int, ...], site: str = "site") -> str:
    x = [f"(({c} + {o} + {7 * 10**6} * {d}) % {d})" if o else c for c, o, d in zip(xs(n, site), offset, ("5", "5", "4", n), strict=True)]
    return f"((({x[0]} * 5 + {x[1]}) * 4 + {x[2]}) * {n} + {x[3]})"


UNIT = [tuple(int(k == d) for k in range(4)) for d in range(4)]


def back(o):
    return tuple(-k for k in o)


# --- 1. lattice -----------------------------------------------------------------------------------------------------
BOX = Lattice((8, 8, 8, 16))


@query("SELECT site, site // 1024 AS x0, (site // 128) % 8 AS x1, (site // 16) % 8 AS x2, site % 16 AS x3 FROM (SELECT unnest(range(8192)) AS site)")
def lattice_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BOX.sites(spark)


_C = "SELECT site, site // 1024 AS x0, (site // 128) % 8 AS x1, (site // 16) % 8 AS x2, site % 16 AS x3 FROM (SELECT unnest(range(8192)) AS site)"


@query(f"SELECT site, (x0 + 8 * x1 + 64 * x2 + 512 * x3) AS lex_x, (x0 + x1 + x2 + x3) % 2 AS parity, (x0 + 8 * x1 + 64 * x2 + 512 * x3) // 2 + 4096 * ((x0 + x1 + x2 + x3) % 2) AS even_odd FROM ({_C})")
def lattice_even_odd(spark, sf_dir):
    site = F.col("site")
    return BOX.sites(spark).select("site", BOX.file_index(BOX.coordinates(site)).alias("lex_x"), BOX.parity(site).alias("parity"), BOX.even_odd_index(site).alias("even_odd"))


@query(f"SELECT site, ((((x0 + 1) * 10 + x1 + 1) * 10 + x2 + 1) * 18 + x3 + 1) AS padded FROM ({_C})")
def lattice_padded(spark, sf_dir):
    lat = BOX.padded((1, 1, 1, 1))
    return lat.sites(spark).select("site", lat.padded_index([F.col(f"x{d}") for d in range(4)]).alias("padded"))


@query(f"SELECT site, x0, x1, x2, x3 FROM ({_C}) WHERE x0 BETWEEN 1 AND 6 AND x1 BETWEEN 1 AND 6 AND x2 BETWEEN 1 AND 6 AND x3 BETWEEN 1 AND 14")
def interior_sites(spark, sf_dir):
    keep = F.lit(True)
    for d, n in enumerate(BOX.dims):
        keep = keep & F.col(f"x{d}").between(1, n - 2)
    return BOX.sites(spark).where(keep)


@query(f"SELECT site, x0, x1, x2, x3 FROM ({_C}) WHERE x3 >= 14")
def face_sites(spark, sf_dir):
    return stencils.faces(spark, BOX, 3, 1, 2)


@query("SELECT site, unnest([1.0, 0.0, 0.0, 1.0]::DOUBLE[]) AS re, unnest([0.0, 0.0, 0.0, 0.0]::DOUBLE[]) AS im, unnest([0, 1, 2, 3]) AS k FROM (SELECT unnest(range(60)) AS site)")
def field_identity(spark, sf_dir):
    return Field.identity(spark, Lattice((3, 4, 5)), 2).long()


# --- 2. scalars -----------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey AS site, round(o_totalprice + o_totalprice * o_totalprice, 2) AS v FROM orders")
def field_add(spark, sf_dir):
    f = X.prices(spark, sf_dir)
    return rounded((f + f.map(lambda a: a * a)).df, "v", digits=2)


@query("SELECT o_orderkey AS site, round(o_totalprice * 2.5, 4) AS v FROM orders")
def field_scale(spark, sf_dir):
    return rounded((X.prices(spark, sf_dir) * 2.5).df, "v", digits=4)


@query("SELECT o_orderkey AS site, round(sqrt(o_totalprice), 6) AS s, round(ln(o_totalprice), 6) AS l, round(sin(o_totalprice), 6) AS si, round(pow(o_totalprice, 0.3), 6) AS p FROM orders")
def field_functions(spark, sf_dir):
    v = F.col("v")
    return rounded(X.prices(spark, sf_dir).df.select("site", F.sqrt(v).alias("s"), A.logarithm(v).alias("l"), F.sin(v).alias("si"), F.pow(v, F.lit(0.3)).alias("p")), "s", "l", "si", "p")


@query("SELECT o_orderkey AS site, o_totalprice > 150000 AS over FROM orders")
def field_compare(spark, sf_dir):
    return X.prices(spark, sf_dir).df.select("site", (F.col("v") > 150000).alias("over"))


@query("SELECT round(sum(o_totalprice), 2) AS v FROM orders")
def global_sum(spark, sf_dir):
    return rounded(X.prices(spark, sf_dir).sum(), "v", digits=2)


@query(f"{E} SELECT {r('sum(e[1])')} AS re, {r('sum(e[2])')} AS im FROM e")
def complex_sum(spark, sf_dir):
    return rounded(X.complex_(spark, sf_dir, 0, ()).sum(), "re", "im")


def _z(f: Field) -> DataFrame:
    return rounded(f.df.select("site", "v.re", "v.im"), "re", "im")


@query(f"{E} SELECT site, {r('e[1] * e[3] - e[2] * e[4]')} AS re, {r('e[1] * e[4] + e[2] * e[3]')} AS im FROM e")
def complex_mul(spark, sf_dir):
    return _z(X.complex_(spark, sf_dir, 0, ()).with_([X.complex_(spark, sf_dir, 2, ())], lambda a, b: a * b))


@query(f"{E} SELECT site, {r('(e[1] * e[3] + e[2] * e[4]) / (e[3] * e[3] + e[4] * e[4])', 4)} AS re, {r('(e[2] * e[3] - e[1] * e[4]) / (e[3] * e[3] + e[4] * e[4])', 4)} AS im FROM e")
def complex_div(spark, sf_dir):
    f = X.complex_(spark, sf_dir, 0, ()).with_([X.complex_(spark, sf_dir, 2, ())], lambda a, b: a / b)
    return rounded(f.df.select("site", "v.re", "v.im"), "re", "im", digits=4)


@query(f"{E} SELECT site, {r('sqrt(e[1] * e[1] + e[2] * e[2])')} AS a, {r('e[1] * e[1] + e[2] * e[2]')} AS n2, {r('-e[2]')} AS im FROM e")
def complex_abs_conj(spark, sf_dir):
    f = X.complex_(spark, sf_dir, 0, ())
    z = f.value()
    return rounded(f.df.select("site", z.abs().alias("a"), z.norm2().alias("n2"), z.conj().im.alias("im")), "a", "n2", "im")


# --- 3. vectors and matrices ----------------------------------------------------------------------------------------
def _pair(spark, sf_dir, shape=(3,), first=3):
    return X.real(spark, sf_dir, 0, shape), X.real(spark, sf_dir, first, shape)


def _long(f: Field, *columns: str, digits: int = DIGITS) -> DataFrame:
    return rounded(f.long(), *(columns or (("re", "im") if f.complex else ("v",))), digits=digits)


@query(f"{E} SELECT site, {r('e[1] * e[4] + e[2] * e[5] + e[3] * e[6]')} AS v FROM e")
def vec_dot(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return rounded(a.with_([b], A.dot, ()).df, "v")


@query(f"{E} SELECT site, {r('sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3])')} AS v FROM e")
def vec_norm(spark, sf_dir):
    return rounded(X.real(spark, sf_dir, 0, (3,)).map(A.norm, ()).df, "v")


@query(f"{E} SELECT site, k, {r('e[k + 1] / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3])')} AS v FROM e, (SELECT unnest([0, 1, 2]) AS k)")
def vec_normalized(spark, sf_dir):
    return _long(X.real(spark, sf_dir, 0, (3,)).map(A.normalized))


@query(f"{E} SELECT site, k, {r('e[k + 1] * e[k + 4] + 2 * e[k + 1] - e[k + 4]')} AS v FROM e, (SELECT unnest([0, 1, 2]) AS k)")
def vec_arithmetic(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return _long(a.with_([b], lambda x, y: A.sub(A.add(A.times(x, y), A.scale(x, F.lit(2.0))), y)))


@query(f"{E} SELECT site, k, {r('e[(k + 1) % 3 + 1] * e[(k + 2) % 3 + 4] - e[(k + 2) % 3 + 1] * e[(k + 1) % 3 + 4]')} AS v FROM e, (SELECT unnest([0, 1, 2]) AS k)")
def vec_cross(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return _long(a.with_([b], A.cross))


@query(f"{E} SELECT site, 3 * i + j AS k, {r('e[i + 1] * e[j + 4]')} AS v FROM e, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)")
def outer_product(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return _long(a.with_([b], A.outer, (3, 3)))


_IJ = "(SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)"


@query(f"{E} SELECT site, 3 * i + j AS k, {r('sum(e[3 * i + l + 1] * e[9 + 3 * l + j + 1])')} AS v FROM e, {_IJ}, (SELECT unnest([0, 1, 2]) AS l) GROUP BY ALL")
def mat_mul(spark, sf_dir):
    a, b = _pair(spark, sf_dir, (3, 3), 9)
    return _long(a.matmul(b))


@query(f"{E} SELECT site, i AS k, {r('sum(e[3 * i + j + 1] * e[10 + j])')} AS v FROM e, {_IJ} GROUP BY ALL")
def mat_vec(spark, sf_dir):
    return _long(X.real(spark, sf_dir, 0, (3, 3)).with_([X.real(spark, sf_dir, 9, (3,))], A.matvec, (3,)))


@query(f"{E} SELECT site, 3 * i + j AS k, {r('e[2 * (3 * j + i) + 1]')} AS re, {r('-e[2 * (3 * j + i) + 2]')} AS im FROM e, {_IJ}")
def mat_adjoint(spark, sf_dir):
    return _long(X.complex_(spark, sf_dir, 0, (3, 3)).map(A.adjoint))


@query(f"{E} SELECT site, 3 * i + j AS k, {r('sum(e[2 * (3 * i + l) + 1] * e[18 + 2 * (3 * l + j) + 1] - e[2 * (3 * i + l) + 2] * e[18 + 2 * (3 * l + j) + 2])')} AS re, {r('sum(e[2 * (3 * i + l) + 1] * e[18 + 2 * (3 * l + j) + 2] + e[2 * (3 * i + l) + 2] * e[18 + 2 * (3 * l + j) + 1])')} AS im FROM e, {_IJ}, (SELECT unnest([0, 1, 2]) AS l) GROUP BY ALL")
def complex_mat_mul(spark, sf_dir):
    return _long(X.complex_(spark, sf_dir, 0, (3, 3)).matmul(X.complex_(spark, sf_dir, 18, (3, 3))))


@query(f"{E} SELECT site, {r('e[1] + e[9] + e[17]')} AS re, {r('e[2] + e[10] + e[18]')} AS im FROM e")
def mat_trace(spark, sf_dir):
    return _z(X.complex_(spark, sf_dir, 0, (3, 3)).map(A.trace, ()))


@query(f"{E} SELECT site, {r('sum(x * x)')} AS v FROM (SELECT site, unnest(e[1:18]) AS x FROM e) GROUP BY site")
def mat_norm2(spark, sf_dir):
    return rounded(X.complex_(spark, sf_dir, 0, (3, 3)).map(A.frobenius_norm2, (), False).df, "v")


_DET = "(e[1] * (e[5] * e[9] - e[6] * e[8]) - e[2] * (e[4] * e[9] - e[6] * e[7]) + e[3] * (e[4] * e[8] - e[5] * e[7]))"


@query(f"{E} SELECT site, {r(_DET, 9)} AS v FROM e")
def mat_det(spark, sf_dir):
    return rounded(X.real(spark, sf_dir, 0, (3, 3)).map(A.determinant, ()).df, "v", digits=9)


def _minor(i: int, j: int) -> str:
    a, b = (k for k in range(3) if k != i)
    c, d = (k for k in range(3) if k != j)
    at = lambda p, q: f"e[{3 * p + q + 1}]"
    return f"({'-' if (i + j) % 2 else ''}({at(a, c)} * {at(b, d)} - {at(a, d)} * {at(b, c)}))"


@query(f"{E} SELECT site, unnest([{', '.join(str(3 * i + j) for i in range(3) for j in range(3))}]) AS k, unnest([{', '.join(f'{r(_minor(j, i), 9)}' for i in range(3) for j in range(3))}]) AS v FROM e")
def mat_adjugate(spark, sf_dir):
    return _long(X.real(spark, sf_dir, 0, (3, 3)).map(A.adjugate), digits=9)


@query(f"{E} SELECT site, unnest([{', '.join(str(3 * i + j) for i in range(3) for j in range(3))}]) AS k, unnest([{', '.join(f'{r(_minor(j, i), 6)}' for i in range(3) for j in range(3))}]) AS v FROM e WHERE {_DET} <> 0")
def mat_inverse(spark, sf_dir):
    """The inverse times the determinant, which is the adjugate, however small the determinant; singular matrices left out."""
    m = X.real(spark, sf_dir, 0, (3, 3))
    m = Field(m.lattice, m.df.where(A.determinant(m.value()) != 0), m.shape)
    return _long(m.inverse() * m.determinant())


@query("SELECT p_partkey, round(exp(x) * sin(x), 6) AS re, round(exp(x) * (sin(x) + cos(x)), 6) AS du FROM (SELECT p_partkey, p_retailprice / 1000 AS x FROM part)")
def dual_exp(spark, sf_dir):
    x = A.Dual(F.col("p_retailprice") / 1000)
    y = x.exp() * x.sin()
    return rounded(X.table(spark, sf_dir, "part").select("p_partkey", y.re.alias("re"), y.du.alias("du")), "re", "du")


@query("SELECT p_partkey, round(ln(x) / (1 + x * x), 6) AS re, round((1 / x * (1 + x * x) - ln(x) * 2 * x) / pow(1 + x * x, 2), 6) AS du, round(0.5 / sqrt(x), 6) AS root, round(1 - pow(tanh(x), 2), 6) AS tanh, round(3 * x * x, 6) AS cube FROM (SELECT p_partkey, p_retailprice / 1000 AS x FROM part)")
def dual_quotient(spark, sf_dir):
    x = A.Dual(F.col("p_retailprice") / 1000)
    y = x.ln() / (A.Dual(1.0, 0.0) + x * x)
    columns = {"re": y.re, "du": y.du, "root": x.sqrt().du, "tanh": x.tanh().du, "cube": x.pow(3).du}
    return rounded(X.table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in columns.items())), *columns)


# --- 4. neighbours --------------------------------------------------------------------------------------------------
def _shift_sql(offset) -> str:
    return f"SELECT {moved(N['o'], back(offset), 'o_orderkey')} AS site, round(o_totalprice, 2) AS v FROM orders"


@query(_shift_sql(UNIT[1]))
def shift_fwd(spark, sf_dir):
    f = X.prices(spark, sf_dir)
    return rounded(f.shift(f.lattice.unit(1)).df, "v", digits=2)


@query(_shift_sql(back(UNIT[3])))
def shift_bwd(spark, sf_dir):
    f = X.prices(spark, sf_dir)
    return rounded(f.transport(3).df, "v", digits=2)


@query(_shift_sql((7, 0, -9, 0)))
def shift_len(spark, sf_dir):
    f = X.prices(spark, sf_dir)
    return rounded(f.shift((7, 0, -9, 0)).df, "v", digits=2)


_L = ["SELECT o_orderkey AS site, -8.0 * o_totalprice AS v FROM orders"] + [f"SELECT {moved(N['o'], o, 'o_orderkey')} AS site, o_totalprice AS v FROM orders" for d in range(4) for o in (UNIT[d], back(UNIT[d]))]


@query(f"SELECT site, round(sum(v), 2) + 0.0 AS v FROM ({' UNION ALL '.join(_L)}) GROUP BY site")
def laplacian(spark, sf_dir):
    return rounded(X.prices(spark, sf_dir).laplacian().df, "v", digits=2)


_SMALL_BOX = Lattice((5, 5, 4, 6))


def _neighbour_sql(points) -> str:
    base = "SELECT unnest(range(600)) AS site"
    out = lambda o: " OR ".join(f"{x} + {k} < 0 OR {x} + {k} >= {d}" for x, k, d in zip(xs("6"), o, (5, 5, 4, 6), strict=True) if k)
    return " UNION ALL ".join(f"SELECT site, {k} AS point, {moved('6', o)} AS neighbour, ({out(o) or False}) AS wraps FROM ({base})" for k, o in enumerate(points))


@query(_neighbour_sql([s for d in range(4) for s in (UNIT[d], back(UNIT[d]))]))
def stencil_neighbors(spark, sf_dir):
    return stencils.neighbours(spark, _SMALL_BOX, stencils.nearest(4))


_CORNERS = [tuple(s * a + t * b for a, b in zip(UNIT[m], UNIT[n], strict=True)) for m in range(4) for n in range(m + 1, 4) for s, t in ((1, 1), (1, -1), (-1, 1), (-1, -1))]


@query(_neighbour_sql([s for d in range(4) for s in (UNIT[d], back(UNIT[d]))] + _CORNERS))
def staple_corners(spark, sf_dir):
    return stencils.neighbours(spark, _SMALL_BOX, stencils.staple(4))


@query(_neighbour_sql([(1, 0, 0, 0), (2, 0, 0, 0), (2, 1, 0, 0), (1, 1, 0, 0), (0, 1, 0, 0), (0, 0, 0, 0)]))
def path_neighbors(spark, sf_dir):
    return stencils.neighbours(spark, _SMALL_BOX, stencils.path(stencils.rectangle(4, 0, 1, 2, 1)))


# --- 5. gauge fields ------------------------------------------------------------------------------------------------
_U = f"{E}, n AS (SELECT {N['e']} AS n), u AS (SELECT site, m, i, j, e[8 * m + 4 * i + 2 * j + 1] AS re, e[8 * m + 4 * i + 2 * j + 2] AS im FROM e, (SELECT unnest([0, 1, 2, 3]) AS m), (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))"
#: Link m seen from the site that it is shifted to: f has the links at x + d.
_F = ", f AS (" + " UNION ALL ".join(f"SELECT {moved('n', back(UNIT[d]))} AS site, {d} AS d, m, i, j, re, im FROM u, n" for d in range(4)) + ")"


def _mm(a: str, b: str, on: str, keys: str, adjoint_b: bool = False) -> str:
    """Sum over the inner index of a(i, l) b(l, j), or of a(i, l) conj(b(j, l))."""
    inner, j, s = ("a.j = b.j", "b.i", 1) if adjoint_b else ("a.j = b.i", "b.j", -1)
    return f"(SELECT {keys}, a.i AS i, {j} AS j, sum(a.re * b.re + {s} * a.im * b.im) AS re, sum(a.im * b.re + {-s} * a.re * b.im) AS im FROM {a} a JOIN {b} b ON {on} AND {inner} GROUP BY ALL)"


#: ta for the ordered pair (p, q): Up(x) Uq(x + p).
_TA = ", t AS " + _mm("u", "f", "a.site = b.site AND b.d = a.m AND b.m <> a.m", "a.site AS site, a.m AS p, b.m AS q")
_PLAQ = "(SELECT sum(a.re * b.re + a.im * b.im) FROM t a JOIN t b ON a.site = b.site AND a.p = b.q AND a.q = b.p AND a.i = b.i AND a.j = b.j AND a.p > a.q)"


@query(f"{_U} SELECT {r('sum(re) / (8 * count(DISTINCT site))', 9)} AS link_trace FROM u WHERE i = j")
def link_trace(spark, sf_dir):
    return rounded(X.links(spark, sf_dir).link_trace(), "link_trace", digits=9)


@query(f"{_U}{_F}{_TA} SELECT {r(f'{_PLAQ} / (6 * 2 * 100 * (SELECT n FROM n))', 12)} AS plaquette")
def plaquette(spark, sf_dir):
    return rounded(X.links(spark, sf_dir).plaquette(), "plaquette", digits=12)


_W = f"{_U}{_F}{_TA}"
#: b for (p, q) at y: Up(y)^dagger Uq(y) Up(y + q), then moved to y + p.
_W += ", ud AS (SELECT site, m, j AS i, i AS j, re, -im AS im FROM u)"
_W += ", uu AS " + _mm("ud", "u", "a.site = b.site AND a.m <> b.m", "a.site AS site, a.m AS p, b.m AS q")
_W += ", b0 AS " + _mm("uu", "f", "a.site = b.site AND b.d = a.q AND b.m = a.p", "a.site AS site, a.p AS p, a.q AS q")
_W += ", b AS (" + " UNION ALL ".join(f"SELECT {moved('n', UNIT[d])} AS site, p, q, i, j, re, im FROM b0, n WHERE p = {d}" for d in range(4)) + ")"
#: c for (p, q): ta Up(x + q)^dagger.
_W += ", c AS " + _mm("t", "f", "a.site = b.site AND b.d = a.q AND b.m = a.p", "a.site AS site, a.p AS p, a.q AS q", True)
_RECT = "(SELECT sum(c.re * b.re + c.im * b.im) FROM c JOIN b ON c.site = b.site AND c.p = b.p AND c.q = b.q AND c.i = b.i AND c.j = b.j)"
_V = "(600 * (SELECT n FROM n))"


@query(f"{_W} SELECT {r(f'(7.5 / 2) * (1.0 * (2 * {_V} - {_PLAQ}) + (-0.05) * (4 * {_V} - {_RECT}))', 6)} AS action")
def wilson_action(spark, sf_dir):
    return rounded(X.links(spark, sf_dir).action(7.5, 1.0, -0.05), "action")


_PSI = "psi AS (SELECT site, i, e[33 + 2 * i] AS re, e[34 + 2 * i] AS im FROM e, (SELECT unnest([0, 1]) AS i))"


def _psi(spark, sf_dir) -> DataFrame:
    return X.complex_(spark, sf_dir, 32, (2,)).df


def _spread(df: DataFrame) -> DataFrame:
    return rounded(df.select("site", F.posexplode("v").alias("k", "z")).select("site", "k", "z.re", "z.im"), "re", "im", digits=9)


@query(f"{_U}, {_PSI}, s AS (SELECT {moved('n', back(UNIT[2]))} AS site, i, re, im FROM psi, n) SELECT u.site, u.i AS k, {r('sum(u.re * s.re - u.im * s.im)', 9)} AS re, {r('sum(u.re * s.im + u.im * s.re)', 9)} AS im FROM u JOIN s ON u.site = s.site AND u.j = s.i AND u.m = 2 GROUP BY ALL")
def covariant_shift(spark, sf_dir):
    return _spread(X.links(spark, sf_dir).covariant(_psi(spark, sf_dir), 2, 1))


@query(f"{_U}, {_PSI} SELECT {moved('n', UNIT[2], 'u.site')} AS site, u.j AS k, {r('sum(u.re * s.re + u.im * s.im)', 9)} AS re, {r('sum(u.re * s.im - u.im * s.re)', 9)} AS im FROM u JOIN psi s ON u.site = s.site AND u.i = s.i AND u.m = 2 CROSS JOIN n GROUP BY ALL")
def covariant_shift_backward(spark, sf_dir):
    return _spread(X.links(spark, sf_dir).covariant(_psi(spark, sf_dir), 2, -1))


# --- 6. seeds and checksums -----------------------------------------------------------------------------------------
def _fnv_sql() -> str:
    h = "14695981039346656037::UHUGEINT"
    value = 0xCBF29CE484222325
    for k in range(8):
        value = (value ^ (12345 >> 8 * k & 0xFF)) * 0x100000001B3 % (1 << 64)
    h = f"{value}::UHUGEINT"
    steps, last = [], "s0"
    sql = f"WITH s0 AS (SELECT site, [x0, x1, x2, x3] AS x, {h} AS h FROM ({_C}))"
    n = 0
    for d in range(4):
        for k in range(8):
            n += 1
            byte = f"((x[{d + 1}] >> {8 * k}) & 255)"
            steps.append(f", s{n} AS MATERIALIZED (SELECT site, x, (xor(h, {byte}::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT AS h FROM {last})")
            last = f"s{n}"
    return sql + "".join(steps) + f" SELECT site, (h // 4294967296::UHUGEINT)::BIGINT AS high, (h % 4294967296::UHUGEINT)::BIGINT AS low FROM {last}"


@query(_fnv_sql())
def site_seed(spark, sf_dir):
    high, low = seeds.site_seed(12345, [F.col(f"x{d}") for d in range(4)])
    return BOX.sites(spark).select("site", high.alias("high"), low.alias("low"))


def _draw_sql(n: int) -> str:
    """A uniform draw in SQL: 13 hex digits of an MD5."""
    digits = f"list_transform(string_split(substr(md5(high || ':' || low || ':{n}'), 1, 13), ''), lambda x: (instr('0123456789abcdef', x) - 1)::BIGINT)"
    return f"(list_reduce({digits}, lambda x, y: x * 16 + y) / 4503599627370496.0::DOUBLE)"


_GAUSS = "sqrt(-2 * ln(1.0 - {u})) * cos(6.283185307179586 * {v})"


@query(f"SELECT site, round({_draw_sql(0)}, 9) AS u, round(2 + {_draw_sql(5)} * 3, 9) AS scaled, round({_GAUSS.format(u=_draw_sql(2), v=_draw_sql(3))}, 6) + 0.0 AS g, round({_GAUSS.format(u=_draw_sql(4), v=_draw_sql(5))}, 6) + 0.0 AS re, round({_GAUSS.format(u=_draw_sql(6), v=_draw_sql(7))}, 6) + 0.0 AS im FROM ({_fnv_sql()})")
def site_draws(spark, sf_dir):
    high, low = seeds.site_seed(12345, [F.col(f"x{d}") for d in range(4)])
    rows = BOX.sites(spark).select("site", high.alias("h"), low.alias("l"))
    h, low, z = F.col("h"), F.col("l"), seeds.gaussian_complex(F.col("h"), F.col("l"), 1)
    out = rows.select("site", seeds.uniform(h, low).alias("u"), seeds.uniform(h, low, 5, 2.0, 5.0).alias("scaled"), seeds.gaussian(h, low, 1).alias("g"), z["re"].alias("re"), z["im"].alias("im"))
    return rounded(rounded(out, "u", "scaled", digits=9), "g", "re", "im")


#: CRC-32 in SQL: the table of 256 steps made from the polynomial, then a fold over the bytes.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_TABLE = "SELECT i, i::BIGINT AS c FROM (SELECT unnest(range(256)) AS i)"
for _ in range(8):
    _TABLE = f"SELECT i, {_STEP} AS c FROM ({_TABLE})"
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(data, ''), lambda x: ord(x)::BIGINT), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295)"
_ROTATED = "bit_xor(((crc << (site % {m})) & 4294967295) | (crc >> (32 - site % {m})))"


@query(f"WITH tab AS (SELECT list(c ORDER BY i) AS t FROM ({_TABLE})), c AS (SELECT site, {_CRC} AS crc FROM (SELECT o_orderkey AS site, o_orderpriority || '|' || o_custkey AS data FROM orders), tab) SELECT {_ROTATED.format(m=29)} AS suma, {_ROTATED.format(m=31)} AS sumb FROM c")
def scidac_checksum(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), F.concat_ws("|", "o_orderpriority", F.col("o_custkey").cast("string")).cast("binary").alias("data"))
    return seeds.scidac_checksum(rows)


@query("SELECT bit_xor(o_custkey) AS xor32, sum(o_custkey)::BIGINT % 4294967296 AS sum32 FROM orders")
def plain_checksum(spark, sf_dir):
    return seeds.plain_checksum(X.table(spark, sf_dir, "orders"), "o_custkey").select(F.col("xor32"), F.col("sum32").cast("long").alias("sum32"))


# --- 7. files, lane layouts, larger matrices, site functions --------------------------------------------------------
@query("SELECT o_orderkey AS site, o_totalprice AS v FROM orders")
def scidac_round_trip(spark, sf_dir):
    path = X.shared_file(spark, "prices.lime")
    scidac.write_field(X.prices(spark, sf_dir), path)
    return scidac.read_field(spark, path).df


@query(f"{E} SELECT site, 3 * i + j AS k, {r('e[2 * (3 * i + j) + 1]')} AS re, {r('e[2 * (3 * i + j) + 2]')} AS im FROM e, {_IJ}")
def scidac_matrix_round_trip(spark, sf_dir):
    path = X.shared_file(spark, "matrices.lime")
    scidac.write_field(X.complex_(spark, sf_dir, 0, (3, 3)), path)
    return _long(scidac.read_field(spark, path, (3, 3), True))


@query(f"{_U} SELECT {r('sum(re) / (8 * count(DISTINCT site))', 9)} AS link_trace FROM u WHERE i = j")
def ildg_link_trace(spark, sf_dir):
    path = X.shared_file(spark, "links.lime")
    scidac.write_links(X.links(spark, sf_dir), path)
    return rounded(scidac.read_links(spark, path, 2).link_trace(), "link_trace", digits=9)


@query("SELECT unnest([0, 1, 2]) AS number, unnest(['ildg-format', 'ildg-binary-data', 'scidac-checksum']) AS type, unnest([true, false, false]) AS begins, unnest([false, false, true]) AS ends, unnest([0, 256 * (SELECT count(*) FROM embeddings), 0]) AS data_bytes")
def lime_records(spark, sf_dir):
    path = X.shared_file(spark, "listed.lime")
    scidac.write_links(X.links(spark, sf_dir), path)
    data = F.when(F.col("type") == scidac.ILDG_BINARY, F.col("length")).otherwise(F.lit(0)).cast("long")
    return lime.contents(spark, path).select("number", "type", "begins", "ends", data.alias("data_bytes"))


_LANES = lanes.LaneLayout(BOX, lanes.lane_grid(BOX.dims, 8))
_G = _LANES.grid


def _lane_sql(part) -> str:
    dims = [n // g for n, g in zip(BOX.dims, _G, strict=True)] if part == "//" else _G
    x = [f"x{d} {part} {g}" for d, g in enumerate(_G)]
    return f"((({x[0]}) * {dims[1]} + ({x[1]})) * {dims[2]} + ({x[2]})) * {dims[3]} + ({x[3]})"


@query(f"SELECT site, {_lane_sql('//')} AS grp, {_lane_sql('%')} AS lane FROM ({_C})")
def lane_layout(spark, sf_dir):
    group, lane = _LANES.place(F.col("site"))
    return BOX.sites(spark).select("site", group.alias("grp"), lane.alias("lane"))


@query(f"SELECT {_lane_sql('//')} AS grp, sum(site)::DOUBLE AS total, min(site)::DOUBLE AS low, max(site)::DOUBLE AS high FROM ({_C}) GROUP BY ALL")
def lane_sums(spark, sf_dir):
    held = _LANES.to_lanes(BOX.sites(spark).select("site", F.col("site").cast("double").alias("v")))
    v = F.col("v")
    return held.select(F.col("group").alias("grp"), lanes.lane_sum(v).alias("total"), lanes.lane_min(v).alias("low"), lanes.lane_max(v).alias("high"))


@query("SELECT o_orderkey AS site, o_totalprice AS v FROM orders")
def lane_round_trip(spark, sf_dir):
    f = X.prices(spark, sf_dir)
    layout = lanes.LaneLayout(f.lattice, lanes.lane_grid(f.lattice.dims, 2, (1, 1, lanes.FREE, 1)))
    return layout.from_lanes(layout.to_lanes(f.df))


@query("SELECT vec_id AS site, k, CASE WHEN k % 6 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM embeddings, (SELECT unnest(range(25))::INTEGER AS k)")
def large_inverse(spark, sf_dir):
    """M M^-1 of 5 x 5 matrices with 4 added on the diagonal."""
    m = X.real(spark, sf_dir, 0, (5, 5)).map(lambda a: A.add(a, A.scale(A.identity(5), F.lit(4.0))))
    return _long(m.matmul(dense.inverse(m)))


@query(f"{E} SELECT site, {r(_DET, 9)} AS v FROM e")
def large_determinant(spark, sf_dir):
    """The numeric way on 3 x 3 matrices, where SQL has a closed form."""
    return rounded(dense.determinant(X.real(spark, sf_dir, 0, (3, 3))).df, "v", digits=9)


@query("SELECT o_orderkey AS site, round(o_totalprice / 2 + 3, 4) AS built_in, round(o_totalprice * o_totalprice / 1000, 4) AS by_series FROM orders")
def site_functions(spark, sf_dir):
    siteops.define("half_plus", 2, lambda x, y: x / 2 + y)
    siteops.register(spark, "thousandth_square", X.thousandth_square)
    v = F.col("v")
    rows = X.prices(spark, sf_dir).df.select("site", siteops.apply("half_plus", v, F.lit(3.0)).alias("built_in"), siteops.apply("thousandth_square", v).alias("by_series"))
    return rounded(rows, "built_in", "by_series", digits=4)
