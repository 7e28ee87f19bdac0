"""Neighbour patterns.  Points are offsets; numbers of points follow the order in which they are added."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate, combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfield.lattice import Lattice


@dataclass(frozen=True)
class Pattern:
    name: str
    points: tuple[tuple[int, ...], ...]

    def add(self, point: tuple[int, ...]) -> Pattern:
        return Pattern(self.name, (*self.points, tuple(point)))


def _rank(x) -> int:
    """Patterns take a number of dimensions or a lattice."""
    return x.rank if isinstance(x, Lattice) else x


def _unit(rank: int, d: int, s: int = 1) -> tuple[int, ...]:
    return tuple(s if k == d else 0 for k in range(rank))


def _plus(a, b):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def nearest(rank: int | Lattice, name: str = "nearest") -> Pattern:
    rank = _rank(rank)
    return Pattern(name, tuple(_unit(rank, d, s) for d in range(rank) for s in (1, -1)))


def laplacian(rank: int | Lattice) -> Pattern:
    return nearest(rank, "laplacian")


def forward(rank: int | Lattice) -> Pattern:
    rank = _rank(rank)
    return Pattern("forward", tuple(_unit(rank, d) for d in range(rank)))


def backward(rank: int | Lattice) -> Pattern:
    rank = _rank(rank)
    return Pattern("backward", tuple(_unit(rank, d, -1) for d in range(rank)))


SIGNS = ((1, 1), (1, -1), (-1, 1), (-1, -1))


def staple(rank: int | Lattice) -> Pattern:
    """Nearest neighbours, then for each pair of directions the four corners."""
    rank = _rank(rank)
    corners = tuple(_plus(_unit(rank, a, s), _unit(rank, b, t)) for a, b in combinations(range(rank), 2) for s, t in SIGNS)
    return Pattern("staple", nearest(rank).points + corners)


def corner_point(rank: int | Lattice, a: int, sa: int, b: int, sb: int) -> int:
    """The number of a corner in staple(); directions may come in either order."""
    rank = _rank(rank)
    if a > b:
        a, sa, b, sb = b, sb, a, sa
    return 2 * rank + 4 * list(combinations(range(rank), 2)).index((a, b)) + SIGNS.index((sa, sb))


def hop_point(d: int, direction: int = 1) -> int:
    """The number of the point one step along or against d in nearest(), laplacian() and staple()."""
    return 2 * d + (direction < 0)


def path(steps: list[tuple[int, ...]], name: str = "path") -> Pattern:
    """The places that a walk visits, its start left out."""
    return Pattern(name, tuple(accumulate(map(tuple, steps), _plus)))


def rectangle(rank: int | Lattice, mu: int, nu: int, a: int, b: int) -> list[tuple[int, ...]]:
    rank = _rank(rank)
    m, n = _unit(rank, mu), _unit(rank, nu)
    back = lambda x: tuple(-k for k in x)
    return [m] * a + [n] * b + [back(m)] * a + [back(n)] * b


def plaquette(rank: int | Lattice, mu: int, nu: int) -> list[tuple[int, ...]]:
    return rectangle(rank, mu, nu, 1, 1)


def neighbours(spark: SparkSession, lattice: Lattice, pattern: Pattern) -> DataFrame:
    """site, point, neighbour, wraps (a ghost neighbour): computed, a row a site and point."""
    site = F.col("site")
    each = F.array(*(F.struct(F.lit(k).alias("point"), lattice.moved(site, o).alias("neighbour"), lattice.wraps(site, o).alias("wraps")) for k, o in enumerate(pattern.points)))
    return lattice.sites(spark).select("site", F.explode(each).alias("p")).select("site", "p.*")


def faces(spark: SparkSession, lattice: Lattice, d: int, direction: int, thickness: int = 1) -> DataFrame:
    """Sites of the halo that a shift along d sends: the last ``thickness`` planes forward, the first backward."""
    x = F.col(f"x{d}")
    return lattice.sites(spark).where(x >= lattice.dims[d] - thickness if direction > 0 else x < thickness)


def shift_sets(spark: SparkSession, lattice: Lattice, d: int, length: int) -> DataFrame:
    """site, source (the site at x + length along d), local (whether that is in the grid without wrapping), sent (whether its
    value is another's wrapped source)."""
    site, x, n = F.col("site"), F.col(f"x{d}"), lattice.dims[d]
    inside = lambda y: (y >= 0) & (y < n)
    return lattice.sites(spark).select("site", lattice.moved(site, lattice.unit(d, length)).alias("source"), inside(x + length).alias("local"), (~inside(x - length)).alias("sent"))
