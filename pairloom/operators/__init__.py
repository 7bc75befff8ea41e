"""Pair reductions, clustering and solvers."""
