"""Read patterns: regions, and the plan they compile to.

A pattern is a row of atoms, holes or terms; atom ``i`` spans the boundaries ``i`` to ``i + 1``.  A plan is a list of
operations that find out where boundaries are: ``Let`` places one at a fixed distance from a known one, ``Restrict``
searches a term within the nearest known boundaries around it.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Hole:
    pass


@dataclass(frozen=True)
class Term:
    """Strings to search: one a choice of the variables in ``uses``, given as (choice of each variable, string)."""

    choices: tuple[tuple[tuple[int, ...], str], ...]
    rate: float = 0.0
    uses: tuple[int, ...] = ()

    @classmethod
    def of(cls, text: str, rate: float = 0.0) -> Term:
        return cls((((), text),), rate)


@dataclass(frozen=True)
class Named:
    name: str
    regions: tuple


@dataclass(frozen=True)
class Sized:
    size: float
    regions: tuple


Region = Hole | Term | Named | Sized


@dataclass(frozen=True)
class Let:
    loc: int
    base: int
    offset: int
    lo: int
    hi: int


@dataclass(frozen=True)
class Restrict:
    atom: int
    term: Term
    lo: int
    hi: int
    fixed_start: bool
    fixed_end: bool


@dataclass
class MatchPlan:
    """What a pattern compiles to; plain data, so that it travels to executors."""

    size: int  # the last boundary
    ops: list[Let | Restrict]
    names: list[tuple[str, int, int]]  # named regions in order, with their boundaries
    variables: int = 0
    checks: list[tuple[int, int, int]] = field(default_factory=list)  # sized regions with both ends known, for strict mode


def sized(n: float) -> Sized:
    return Sized(n, (Hole(),))


def named(name: str, *regions: Region) -> Named:
    return Named(name, regions)


def _flatten(regions, start: int, atoms: list, names: list, sizes: list) -> int:
    at = start
    for r in regions:
        if isinstance(r, (Hole, Term)):
            atoms.append(r)
            at += 1
        elif isinstance(r, Named):
            slot = len(names)
            names.append(None)
            end = _flatten(r.regions, at, atoms, names, sizes)
            names[slot] = (r.name, at, end)
            at = end
        else:
            end = _flatten(r.regions, at, atoms, names, sizes)
            sizes.append((at, end, round_half_away(r.size)))
            at = end
    return at


def round_half_away(x: float) -> int:
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def compile_regions(regions, variables: int = 0) -> MatchPlan:
    """Terms from left to right; before each, and at the end, whatever sizes tell from a known boundary is placed.

    Sizes are applied in rounds: one round places the other end of every region of which just one end was known before it, anywhere
    between the boundaries around the region that were known then.  So regions of one round don't limit each other, and may overlap.
    """
    atoms: list = []
    names: list = []
    sizes: list = []
    n = _flatten(regions, 0, atoms, names, sizes)
    known, ops, checks = {0, n}, [], []

    def around(lo: int, hi: int) -> tuple[int, int]:
        return max(k for k in known if k <= lo), min(k for k in known if k >= hi)

    def settle() -> None:
        nonlocal sizes
        while True:
            ends = [(start in known, end in known) for start, end, _ in sizes]
            checks.extend(s for s, both in zip(sizes, ends) if all(both))
            placed = [Let(*((end, start, size) if left else (start, end, -size)), *around(start, end)) for (start, end, size), (left, right) in zip(sizes, ends) if left != right]
            sizes = [s for s, both in zip(sizes, ends) if not any(both)]
            if not placed:
                return
            ops.extend(placed)
            known.update(p.loc for p in placed)

    for i, atom in enumerate(atoms):
        if isinstance(atom, Term):
            settle()
            lo, hi = around(i, i + 1)
            ops.append(Restrict(i, atom, lo, hi, lo == i, hi == i + 1))
            known |= {i, i + 1}
    settle()
    # Boundaries between two holes that nothing places stay unknown; a region that needs one can't be cut out.
    for name, lo, hi in names:
        if lo not in known or hi not in known:
            raise ValueError(f"nothing tells where region '{name}' begins or ends")
    return MatchPlan(n, ops, names, variables, checks)
