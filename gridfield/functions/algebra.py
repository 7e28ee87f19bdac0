"""Site-wise algebra as column expressions: complex numbers, vectors, matrices, dual numbers.

Small tensors are unrolled at plan time into plain arithmetic, which whole-stage codegen compiles.  Division follows
IEEE (x/0 is an infinity or NaN) whatever the session's ANSI mode.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def ratio(a, b) -> Column:
    a, b = number(a), number(b)
    zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def logarithm(x) -> Column:
    x = number(x)
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.log(F.when(x > 0, x)))


class Complex:
    """A pair of columns."""

    __slots__ = ("re", "im")

    def __init__(self, re, im=0.0):
        self.re, self.im = number(re), number(im)

    @staticmethod
    def of(x) -> Complex:
        return x if isinstance(x, Complex) else Complex(x)

    @staticmethod
    def stored(column: Column) -> Complex:
        return Complex(column["re"], column["im"])

    def column(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"))

    def __add__(self, o):
        if isinstance(o, Dual):
            return NotImplemented
        o = Complex.of(o)
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o):
        if isinstance(o, Dual):
            return NotImplemented
        o = Complex.of(o)
        return Complex(self.re - o.re, self.im - o.im)

    def __rsub__(self, o):
        return Complex.of(o) - self

    def __mul__(self, o):
        if isinstance(o, Dual):
            return NotImplemented
        o = Complex.of(o)
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    __radd__, __rmul__ = __add__, __mul__

    def __truediv__(self, o):
        if isinstance(o, Dual):
            return NotImplemented
        o = Complex.of(o)
        top, n = self * o.conj(), o.norm2()
        return Complex(ratio(top.re, n), ratio(top.im, n))

    def __rtruediv__(self, o):
        return Complex.of(o) / self

    def __neg__(self):
        return Complex(-self.re, -self.im)

    def same(self, o) -> Column:
        o = Complex.of(o)
        return (self.re == o.re) & (self.im == o.im)

    def conj(self):
        return Complex(self.re, -self.im)

    def norm2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.hypot(self.re, self.im)

    # elementary functions, by their real and imaginary parts
    def exp(self):
        return Complex(F.exp(self.re) * F.cos(self.im), F.exp(self.re) * F.sin(self.im))

    def ln(self):
        return Complex(logarithm(self.abs()), F.atan2(self.im, self.re))

    def sqrt(self):
        """The root with a real part that isn't negative."""
        r = self.abs()
        half = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) / 2)  # noqa: E731  rounding may leave a negative zero
        return Complex(half(r + self.re), F.when(self.im < 0, -half(r - self.re)).otherwise(half(r - self.re)))

    def sin(self):
        return Complex(F.sin(self.re) * F.cosh(self.im), F.cos(self.re) * F.sinh(self.im))

    def cos(self):
        return Complex(F.cos(self.re) * F.cosh(self.im), -F.sin(self.re) * F.sinh(self.im))

    def sinh(self):
        return Complex(F.sinh(self.re) * F.cos(self.im), F.cosh(self.re) * F.sin(self.im))

    def cosh(self):
        return Complex(F.cosh(self.re) * F.cos(self.im), F.sinh(self.re) * F.sin(self.im))

    def tan(self):
        return self.sin() / self.cos()

    def tanh(self):
        return self.sinh() / self.cosh()

    def pow(self, p):
        """exp(p ln z)."""
        return (Complex.of(p) * self.ln()).exp()


def scalar(x):
    """A column or a pair of columns, whatever x is."""
    return x if isinstance(x, Complex) else number(x)


def over(a, b):
    """Quotient of scalars, real or complex."""
    a, b = scalar(a), scalar(b)
    return Complex.of(a) / b if isinstance(a, Complex) or isinstance(b, Complex) else ratio(a, b)


def product_of(a, b):
    """Product of scalars, real or complex."""
    return b * a if isinstance(b, Complex) else a * b


def sum_of(a, b):
    return b + a if isinstance(b, Complex) else a + b


def difference_of(a, b):
    return Complex.of(a) - b if isinstance(b, Complex) else a - b


#: Functions that scalars, scalar fields and dual numbers have.
ELEMENTARY = ("sqrt", "exp", "ln", "sin", "cos", "tan", "sinh", "cosh", "tanh")


def call(name: str, x):
    """An elementary function of a scalar, real or complex."""
    if name not in ELEMENTARY:
        raise ValueError(f"no function {name}")
    x = scalar(x)
    return getattr(x, name)() if isinstance(x, Complex) else logarithm(x) if name == "ln" else getattr(F, name)(x)


def power(x, p):
    x = scalar(x)
    return x.pow(p) if isinstance(x, Complex) else F.pow(x, number(p))


class Dual:
    """Forward-mode derivative: value and derivative, real (columns) or complex."""

    __slots__ = ("re", "du")

    def __init__(self, re, du=1.0):
        self.re, self.du = scalar(re), scalar(du)
        if isinstance(self.re, Complex) or isinstance(self.du, Complex):
            self.re, self.du = Complex.of(self.re), Complex.of(self.du)

    @property
    def complex(self) -> bool:
        return isinstance(self.re, Complex)

    @staticmethod
    def of(x) -> Dual:
        return x if isinstance(x, Dual) else Dual(x, 0.0)

    @staticmethod
    def stored(column: Column, complex_: bool = False) -> Dual:
        return Dual(Complex.stored(column["re"]), Complex.stored(column["du"])) if complex_ else Dual(column["re"], column["du"])

    def column(self) -> Column:
        return F.struct(*((x.column() if self.complex else x).alias(n) for n, x in (("re", self.re), ("du", self.du))))

    def text(self) -> Column:
        """As (re + du epsilon); complex parts as (re, im)."""
        one = lambda x: F.concat(F.lit("("), x.re.cast("string"), F.lit(", "), x.im.cast("string"), F.lit(")")) if self.complex else x.cast("string")
        return F.concat(F.lit("("), one(self.re), F.lit(" + "), one(self.du), F.lit("\u03b5)"))

    def __add__(self, o):
        o = Dual.of(o)
        return Dual(sum_of(self.re, o.re), sum_of(self.du, o.du))

    def __sub__(self, o):
        o = Dual.of(o)
        return Dual(difference_of(self.re, o.re), difference_of(self.du, o.du))

    def __rsub__(self, o):
        return Dual.of(o) - self

    def __mul__(self, o):
        o = Dual.of(o)
        return Dual(product_of(self.re, o.re), sum_of(product_of(self.re, o.du), product_of(self.du, o.re)))

    __radd__, __rmul__ = __add__, __mul__

    def __truediv__(self, o):
        o = Dual.of(o)
        top = difference_of(product_of(self.du, o.re), product_of(self.re, o.du))
        return Dual(over(self.re, o.re), over(top, product_of(o.re, o.re)))

    def __neg__(self):
        return Dual(-self.re, -self.du)

    def __eq__(self, o):
        o = Dual.of(o)
        if self.complex or o.complex:
            return Complex.of(self.re).same(o.re) & Complex.of(self.du).same(o.du)
        return (self.re == o.re) & (self.du == o.du)

    __hash__ = None

    def conjugate(self):
        """Of both parts; the same for real ones."""
        return Dual(conj(self.re), conj(self.du))

    def dual_conjugate(self):
        return Dual(self.re, -self.du)

    def adj(self):
        """Both parts conjugated, the derivative negated."""
        return self.conjugate().dual_conjugate()

    def norm2(self):
        return self * self.conjugate()

    def _chain(self, value, slope):
        return Dual(value, product_of(self.du, slope))

    def sqrt(self):
        r = call("sqrt", self.re)
        return Dual(r, over(self.du, sum_of(r, r)))

    def exp(self):
        return self._chain(call("exp", self.re), call("exp", self.re))

    def ln(self):
        return Dual(call("ln", self.re), over(self.du, self.re))

    def sin(self):
        return self._chain(call("sin", self.re), call("cos", self.re))

    def cos(self):
        return self._chain(call("cos", self.re), -call("sin", self.re))

    def tan(self):
        c = call("cos", self.re)
        return Dual(call("tan", self.re), over(self.du, product_of(c, c)))

    def sinh(self):
        return self._chain(call("sinh", self.re), call("cosh", self.re))

    def cosh(self):
        return self._chain(call("cosh", self.re), call("sinh", self.re))

    def tanh(self):
        c = call("cosh", self.re)
        return Dual(call("tanh", self.re), over(self.du, product_of(c, c)))

    def pow(self, p):
        """The derivative at 0 is NaN, as the value is divided by itself."""
        value = power(self.re, p)
        return Dual(value, product_of(over(product_of(value, scalar(p)), self.re), self.du))

    def abs(self):
        """Of real ones."""
        if self.complex:
            raise ValueError("complex dual numbers have norm2, but no abs")
        return Dual(F.abs(self.re), ratio(F.abs(self.re), self.re) * self.du)


def is_dual(x) -> bool:
    return isinstance(x, Dual)


def is_real_dual(x) -> bool:
    return isinstance(x, Dual) and not x.complex


def is_complex_dual(x) -> bool:
    return isinstance(x, Dual) and x.complex


# vectors: lists of columns or Complex; matrices: lists of rows
def conj(x):
    return x.conj() if isinstance(x, Complex) else x


def total(xs):
    out = None
    for x in xs:
        out = x if out is None else out + x
    return out


def norm2_of(x) -> Column:
    return x.norm2() if isinstance(x, Complex) else x * x


def add(a, b):
    """b: of the same shape, or a scalar that is added to every element."""
    if isinstance(a, list):
        return [add(x, y) for x, y in zip(a, b, strict=True)] if isinstance(b, list) else [add(x, b) for x in a]
    return sum_of(a, b)


def sub(a, b):
    """b: of the same shape, or a scalar that is taken from every element."""
    if isinstance(a, list):
        return [sub(x, y) for x, y in zip(a, b, strict=True)] if isinstance(b, list) else [sub(x, b) for x in a]
    return difference_of(a, b)


def divide(a, b):
    """b: a scalar."""
    return [divide(x, b) for x in a] if isinstance(a, list) else over(a, b)


def times(a, b):
    """Element by element."""
    return [times(x, y) for x, y in zip(a, b, strict=True)] if isinstance(a, list) else product_of(a, b)


def scale(a, s):
    return [scale(x, s) for x in a] if isinstance(a, list) else product_of(a, s)


def negate(a):
    return [negate(x) for x in a] if isinstance(a, list) else -a


def conjugate(a):
    return [conjugate(x) for x in a] if isinstance(a, list) else conj(a)


def dot(a, b, conjugate_first: bool = True):
    return total(product_of(conj(x) if conjugate_first else x, y) for x, y in zip(a, b, strict=True))


def norm2(a) -> Column:
    flat = [x for r in a for x in r] if isinstance(a[0], list) else a
    return total(norm2_of(x) for x in flat)


def norm(a) -> Column:
    return F.sqrt(norm2(a))


def normalized(a):
    n = norm(a)
    return [Complex(ratio(x.re, n), ratio(x.im, n)) if isinstance(x, Complex) else ratio(x, n) for x in a]


def cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def outer(a, b):
    """Without conjugation."""
    return [[product_of(x, y) for y in b] for x in a]


def matmul(a, b):
    return [[total(product_of(a[i][k], b[k][j]) for k in range(len(b))) for j in range(len(b[0]))] for i in range(len(a))]


def matvec(a, v):
    return [total(product_of(x, y) for x, y in zip(row, v, strict=True)) for row in a]


def transpose(a):
    return [list(r) for r in zip(*a, strict=True)]


def adjoint(a):
    return conjugate(transpose(a))


def trace(a):
    return total(a[i][i] for i in range(len(a)))


def identity(n: int, complex_: bool = False):
    one = (lambda x: Complex(x)) if complex_ else number
    return [[one(1.0 if i == j else 0.0) for j in range(n)] for i in range(n)]


def _sign(p) -> int:
    return -1 if sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2 else 1


def determinant(a):
    """n up to 4, as a sum over permutations."""
    n = len(a)
    if n > 4:
        raise ValueError("closed forms go to 4 x 4; use gridfield.operators.dense for larger ones")
    out = None
    for p in permutations(range(n)):
        term = a[0][p[0]]
        for i in range(1, n):
            term = term * a[i][p[i]]
        out = (term if out is None else out + term) if _sign(p) > 0 else (-term if out is None else out - term)
    return out


def adjugate(a):
    n = len(a)
    if n == 1:
        return [[Complex(1.0) if isinstance(a[0][0], Complex) else number(1.0)]]
    minor = lambda i, j: [[a[r][c] for c in range(n) if c != j] for r in range(n) if r != i]
    signed = lambda x, i, j: -x if (i + j) % 2 else x
    return [[signed(determinant(minor(j, i)), i, j) for j in range(n)] for i in range(n)]


def inverse(a, group: str = "none"):
    """Orthogonal groups: transpose; unitary ones: adjoint; others: adjugate over determinant."""
    if group in ("O", "SO"):
        return transpose(a)
    if group in ("U", "SU"):
        return adjoint(a)
    d = determinant(a)
    if isinstance(d, Complex):
        return [[x / d for x in r] for r in adjugate(a)]
    return [[ratio(x, d) for x in r] for r in adjugate(a)]


frobenius_norm2 = norm2


def trace_norm2(a) -> Column:
    """tr(A^dagger A), which is the squared Frobenius norm."""
    t = trace(matmul(adjoint(a), a))
    return t.re if isinstance(t, Complex) else t


def parts(a, which: str):
    """Real or imaginary parts of complex elements."""
    return [parts(x, which) for x in a] if isinstance(a, list) else getattr(a, which)


def as_complex(a):
    return [as_complex(x) for x in a] if isinstance(a, list) else Complex.of(a)


def choose(condition, a, b):
    """a where the condition holds (None: everywhere), else b."""
    if condition is None:
        return a
    if isinstance(a, Complex) or isinstance(b, Complex):
        a, b = Complex.of(a), Complex.of(b)
        return Complex(F.when(condition, a.re).otherwise(b.re), F.when(condition, a.im).otherwise(b.im))
    return F.when(condition, a).otherwise(b)


# storage: flat row-major arrays
def load(column: Column, shape: tuple[int, ...], complex_: bool = False):
    one = lambda k: Complex.stored(F.get(column, F.lit(k))) if complex_ else F.get(column, F.lit(k))
    if len(shape) == 0:
        return Complex.stored(column) if complex_ else column

    def build(s, first, step):
        step //= s[0]
        return [one(first + k) if len(s) == 1 else build(s[1:], first + k * step, step) for k in range(s[0])]

    return build(tuple(shape), 0, math.prod(shape))


def flatten(a) -> list:
    return [y for x in a for y in flatten(x)] if isinstance(a, list) else [a]


def save(a) -> Column:
    """An array column; of one element, for scalars, the bare value."""
    one = lambda x: x.column() if isinstance(x, (Complex, Dual)) else x
    return F.array(*(one(x) for x in flatten(a))) if isinstance(a, list) else one(a)
