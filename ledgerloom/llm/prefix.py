"""Running sums over a sorted table of any size (the operator lies in the core)."""

from ledgerloom.operators.prefix import prefix_sums

__all__ = ["prefix_sums"]
