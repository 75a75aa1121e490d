"""Template thinning: the neighbourhood of a sample is one number, a template two or three masks of it.

A sample on (at ``level`` or more) goes when a template matches.  Templates
say which neighbours must be on and which off; some also want a sample two
steps away, which makes one of two opposite templates yield where a sheet is
two samples thick, so that all samples of a pass can be judged at once.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from . import stencil
from .graph import cut

Place = tuple[int, int, int]

# Directions as z, y, x.
X0, X1, Y0, Y1, Z0, Z1 = (0, 0, -1), (0, 0, 1), (0, -1, 0), (0, 1, 0), (-1, 0, 0), (1, 0, 0)
NEAR: list[Place] = list(product((-1, 0, 1), repeat=3))

# Of each pair and triple of directions, those whose sample two steps away must be on as well;
# for (X0, Z0) it is a corner instead.
SINGLES = {(X0,): (X0,), (X1,): (), (Y0,): (Y0,), (Y1,): (), (Z0,): (), (Z1,): (Z1,)}
PAIRS = {
    (X1, Z1): (Z1,),
    (X0, Z1): (X0, Z1),
    (X1, Y0): (Y0,),
    (X0, Y0): (X0, Y0),
    (X1, Y1): (Y1,),
    (X0, Y1): (X0, Y1),
    (X1, Z0): (Z0,),
    (X0, Z0): (),
    (Y0, Z0): (Y0,),
    (Y0, Z1): (Y0, Z1),
    (Y1, Z0): (Y1,),
    (Y1, Z1): (Y1, Z1),
}
CORNER = {(X0, Z0): (-1, -1, -1)}
TRIPLES = {
    (X0, Y1, Z0): (X0,),
    (X0, Y1, Z1): (X0, Z1),
    (X0, Y0, Z0): (Y0,),
    (X0, Y0, Z1): (Y0, Z1),
    (X1, Y0, Z0): (X1,),
    (X1, Y0, Z1): (X1, Z1),
    (X1, Y1, Z0): (Y1,),
    (X1, Y1, Z1): (Y1, Z1),
}
# Edges that bridge two opposite neighbours, and edges that end a sheet, with the two far samples of which one may stand in.
BRIDGES = [(X1, Z0), (X0, Z0), (X0, Y1), (X0, Y0), (Y1, Z0), (Y1, Z1)]
ENDS = {(X0, Z1): (X0, Y0), (X1, Z1): (X1, Z1), (X1, Y0): (X1, Y0), (X1, Y1): (X1, Y1), (Y0, Z1): (Y1, Z0), (Y0, Z0): (Y1, Z1)}
# Two neighbours that make the sample the corner of an end, which stays.
CORNERS = [(Y0, X1), (Y0, Z1), (Y1, X0), (Z1, X0), (Y1, Z0), (X1, Z0)]


def plus(*steps: Place) -> Place:
    return tuple(sum(k) for k in zip(*steps, strict=True))


def dot(a: Place, b: Place) -> int:
    return sum(i * j for i, j in zip(a, b, strict=True))


def beyond(a: Place, b: Place) -> list[Place]:
    """The three samples outside the 27 that lie past the edge a + b."""
    return [plus(a, a, b), plus(a, a, b, b), plus(a, b, b)]


FAR: list[Place] = [plus(d, d) for d in (X0, X1, Y0, Y1, Z0, Z1)]
BITS: dict[Place, int] = {p: i for i, p in enumerate([*NEAR, *FAR, *[p for e in ENDS for p in beyond(*e)]])}


def mask(places: list[Place]) -> int:
    return sum(1 << BITS[p] for p in set(places))


def templates() -> list[tuple[int, int, int]]:
    """(on, off, any): all of ``on`` and none of ``off`` are on, and one of ``any`` unless it is 0."""
    found = []
    for dirs, far in (SINGLES | PAIRS | TRIPLES).items():
        # Off is what lies on the other side of every direction, or level with it, but not level with all.
        off = [p for p in NEAR if all(dot(p, d) <= 0 for d in dirs) and any(dot(p, d) < 0 for d in dirs)]
        found.append((mask([*dirs, *[plus(d, d) for d in far], *([CORNER[dirs]] if dirs in CORNER else [])]), mask(off), 0))
    for a, b in BRIDGES:
        ring = [p for p in NEAR if any(p) and p != plus(a, b) and all(k == 0 for k, i, j in zip(p, a, b, strict=True) if not i and not j)]
        axis = next(d for d in (X1, Y1, Z1) if dot(d, a) == 0 and dot(d, b) == 0)
        found.append((mask([plus(a, b), axis, tuple(-k for k in axis)]), mask(ring), 0))
    for (a, b), far in ENDS.items():
        off = [p for p in NEAR if dot(p, a) < 0 or dot(p, b) < 0]
        found.append((mask([plus(a, b)]), mask([*off, a, b]), mask([plus(d, d) for d in far] + beyond(a, b))))
    return found


def thin_once(level: float) -> stencil.Stencil:
    """One pass, for ``stencil.apply`` with a radius of 2: what a template matches goes, unless it is a line's end."""

    def run(a: np.ndarray, r: int) -> np.ndarray:
        views = dict(stencil.shifts(a, r))
        code = np.zeros(stencil.core(a, r).shape, np.int64)
        for p, bit in BITS.items():
            code |= (views[p] >= level).astype(np.int64) << bit
        near = sum((code >> BITS[p]) & 1 for p in NEAR)
        ends = np.zeros(code.shape, bool)
        for pair in CORNERS:
            ends |= code & mask(list(pair)) == mask(list(pair))
        stays = (near == 2) | ((near == 3) & ends)
        drop = np.zeros(code.shape, bool)
        for on, off, some in templates():
            drop |= (code & on == on) & (code & off == 0) & ((some == 0) | (code & some != 0))
        v = stencil.core(a, r)
        return np.where((drop & ~stays) | (v < level), 0.0, v)

    return run


def skeleton(vox: DataFrame, dims: tuple[int, int, int], level: float = 0.1, most: int = 100) -> DataFrame:
    """t, c, z, y, x, v of what is left when passes take nothing away any more, or after ``most``.

    A pass is one shuffle of the samples to their bricks, with a border of two samples.
    """
    left = None
    for _ in range(most):
        vox = cut(stencil.apply(vox, dims, 2, thin_once(level)))
        now = vox.count()
        if now == left:
            break
        left = now
    return vox
