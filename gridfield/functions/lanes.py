"""Lane layouts: a site's group and lane, groups as rows of lane-major arrays, and sums over lanes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfield.lattice import Lattice, product, whole

FREE = -1


def lane_grid(dims: tuple[int, ...], lanes: int, given: tuple[int, ...] = ()) -> tuple[int, ...]:
    """Lanes along each dimension.  Those given must divide; of the others, the one with most sites a lane takes the next
    prime factor of the lanes that divides it, large factors first; of several the one with fewest lanes, then the last."""
    grid = [g if g > 0 else 1 for g in given or (FREE,) * len(dims)]
    free = [d for d, g in enumerate(given or (FREE,) * len(dims)) if g <= 0]
    if any(n % g for n, g in zip(dims, grid, strict=True)) or lanes % product(grid):
        raise ValueError("lanes must divide the grid and the number of lanes")
    left, factors = lanes // product(grid), []
    while left > 1:
        factors.append(next(f for f in range(2, left + 1) if left % f == 0))
        left //= factors[-1]
    for f in reversed(factors):
        fits = [d for d in free if dims[d] // grid[d] % f == 0]
        if not fits:
            raise ValueError(f"{lanes} lanes don't fit on {dims}")
        grid[max(fits, key=lambda d: (dims[d] // grid[d], -grid[d], d))] *= f
    return tuple(grid)


@dataclass(frozen=True)
class LaneLayout:
    """Neighbouring sites go to the lanes of one group: group coordinate x // lanes, lane coordinate x % lanes."""

    lattice: Lattice
    grid: tuple[int, ...]

    @property
    def groups(self) -> Lattice:
        return Lattice(tuple(n // g for n, g in zip(self.lattice.dims, self.grid, strict=True)))

    @property
    def lanes(self) -> Lattice:
        return Lattice(self.grid)

    def ghost_groups(self, ghosts: tuple[int, ...]) -> int:
        """Groups in the ghost layers on both sides of every dimension."""
        whole = self.groups
        return sum(2 * g * whole.volume // n for g, n in zip(ghosts, whole.dims, strict=True))

    def place(self, site: Column) -> tuple[Column, Column]:
        xs = self.lattice.coordinates(site)
        group = self.groups.index([whole(x, g) for x, g in zip(xs, self.grid, strict=True)])
        return group.cast("long"), self.lanes.index([F.pmod(x, F.lit(g)) for x, g in zip(xs, self.grid, strict=True)]).cast("long")

    def site(self, group: Column, lane: Column) -> Column:
        xs = [x * F.lit(g) + y for x, y, g in zip(self.groups.coordinates(group), self.lanes.coordinates(lane), self.grid, strict=True)]
        return self.lattice.index(xs).cast("long")

    def array_index(self, group: Column, lane: Column, element: Column, elements: int) -> Column:
        """Place in one array of groups, their elements, and their lanes."""
        n = F.lit(self.lanes.volume)
        return group * F.lit(elements) * n + element * n + lane

    def neighbour(self, group: Column, lane: Column, offset: tuple[int, ...]) -> tuple[Column, Column]:
        return self.place(self.lattice.moved(self.site(group, lane), offset))

    def to_lanes(self, df: DataFrame) -> DataFrame:
        """group, and v: the values of its lanes in order.  A group has as many rows as there are lanes."""
        group, lane = self.place(F.col("site"))
        rows = df.select(group.alias("group"), lane.alias("lane"), "v")
        held = rows.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("lane", "v"))).alias("all"))
        return held.select("group", F.transform("all", lambda x: x["v"]).alias("v"))

    def from_lanes(self, df: DataFrame) -> DataFrame:
        rows = df.select("group", F.posexplode("v").alias("lane", "v"))
        return rows.select(self.site(F.col("group"), F.col("lane").cast("long")).alias("site"), "v")


# vectors of lanes as arrays
def splat(x, lanes: int) -> Column:
    return F.array_repeat(x if isinstance(x, Column) else F.lit(x), lanes)


def by_lane(f, a: Column, b: Column) -> Column:
    """f lane by lane, as a sum or product."""
    return F.zip_with(a, b, f)


def madd(a: Column, b: Column, c: Column) -> Column:
    return F.zip_with(F.zip_with(a, b, lambda x, y: x * y), c, lambda x, y: x + y)


def lane_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def lane_product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def lane_min(a: Column) -> Column:
    return F.array_min(a)


def lane_max(a: Column) -> Column:
    return F.array_max(a)


def strided(a: Column, first: int, step: int, lanes: int) -> Column:
    """Elements first, first + step, ..."""
    return F.array(*(F.get(a, F.lit(first + k * step)) for k in range(lanes)))
