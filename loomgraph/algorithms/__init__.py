"""Graph algorithms: distributed loops (iterative) and driver-bound ones with a stated limit (sequential)."""

from loomgraph.algorithms import iterative, sequential

__all__ = ["iterative", "sequential"]
