"""onefold: one-round distributed regression and feature preparation on Spark."""

from onefold.spec import INTERCEPT, OTHERS, Factor, TermSpec

__all__ = ["INTERCEPT", "OTHERS", "Factor", "TermSpec"]
__version__ = "0.1.0"
