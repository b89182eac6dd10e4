"""The term list of a model: one order for coefficients, moments, Hessian rows and columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHERS = "000_OTHERS"
INTERCEPT = "intercept"

# Default limit of all terms: the Hessian has p * p entries. Checked when levels are read.
MAX_TERMS = 2_000


@dataclass(frozen=True)
class Factor:
    """A categorical column with its kept levels and the level that gets no term.

    ``levels`` is in code order (most frequent first) and holds ``OTHERS`` when
    rare levels were collapsed.
    """

    name: str
    levels: tuple[str, ...]
    baseline: str | None = None

    @classmethod
    def build(cls, name: str, levels: Sequence[str], baseline: str | None = "none") -> Factor:
        """``baseline`` is ``none``, ``first`` (by name), ``last`` (least frequent) or a level."""
        levels = tuple(levels)
        if not levels:
            raise ValueError(f"factor {name} has no kept level")
        if baseline in (None, "none"):
            chosen = None
        elif baseline == "first":
            chosen = min(levels)
        elif baseline == "last":
            chosen = levels[-1]
        elif baseline in levels:
            chosen = baseline
        else:
            raise ValueError(f"baseline {baseline!r} is not a level of {name}")
        return cls(name, levels, chosen)

    @property
    def slots(self) -> tuple[str, ...]:
        """Levels with a term, sorted by name."""
        return tuple(sorted(lv for lv in self.levels if lv != self.baseline))

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(f"{self.name}_{lv}" for lv in self.slots)


@dataclass(frozen=True)
class TermSpec:
    """Response, predictors and model keys of one regression (or one per model key)."""

    response: str
    continuous: tuple[str, ...] = ()
    factors: tuple[Factor, ...] = ()
    intercept: bool = False
    keys: tuple[str, ...] = ()
    scales: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "continuous", tuple(sorted(self.continuous)))
        object.__setattr__(self, "factors", tuple(self.factors))
        object.__setattr__(self, "keys", tuple(self.keys))

    @property
    def terms(self) -> list[str]:
        head = [INTERCEPT] if self.intercept else []
        return head + list(self.continuous) + [t for f in self.factors for t in f.terms]

    @property
    def p(self) -> int:
        return len(self.terms)

    @property
    def widths(self) -> list[int]:
        """Number of terms of each factor."""
        return [len(f.slots) for f in self.factors]

    def offset(self, factor: Factor) -> int:
        """Position of the first term of ``factor``."""
        at = int(self.intercept) + len(self.continuous)
        for f in self.factors:
            if f.name == factor.name:
                return at
            at += len(f.slots)
        raise KeyError(factor.name)

    def with_scales(self, stats: DataFrame) -> TermSpec:
        """Take mean and sd of the continuous terms from a statistics frame."""
        wanted = [c for c in self.continuous]
        rows = stats.filter(F.col("col").isin(wanted)).select("col", "mean", "sd").collect()
        scales = {r["col"]: (r["mean"], r["sd"]) for r in rows}
        missing = set(wanted) - set(scales)
        if missing:
            raise ValueError(f"no statistics for {sorted(missing)}")
        return TermSpec(self.response, self.continuous, self.factors, self.intercept,
                        self.keys, scales)

    @classmethod
    def from_levels(
        cls,
        levels: DataFrame,
        response: str,
        continuous: Iterable[str] = (),
        factors: Sequence[str] = (),
        baseline: str | Mapping[str, str] = "none",
        intercept: bool = False,
        keys: Sequence[str] = (),
        max_terms: int = MAX_TERMS,
    ) -> TermSpec:
        """Read the kept levels (``factor, level, code``) of a term-level frame.

        Only kept levels come to the driver; with the continuous terms and the intercept there
        may be ``max_terms`` of them.
        """
        room = max_terms - len(tuple(continuous)) - int(intercept)
        rows = (
            levels.filter(F.col("factor").isin(list(factors)))
            .select("factor", "level", "code")
            .limit(max(0, room) + 1)
            .collect()
        )
        if len(rows) > room:
            raise ValueError(f"more than {max_terms} terms; lower keep_top")
        built = []
        for name in factors:
            own = [r for r in rows if r["factor"] == name]
            kept = [r["level"] for r in sorted(own, key=lambda r: r["code"])]
            base = baseline if isinstance(baseline, str) else baseline.get(name, "none")
            built.append(Factor.build(name, kept, base))
        return cls(response, tuple(continuous), tuple(built), intercept, tuple(keys))
