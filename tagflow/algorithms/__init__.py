"""Computations built on the operators: recursion, search, shortest paths, stencils and tiled linear algebra."""
