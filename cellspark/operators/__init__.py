"""Relational operators over cells: joins, aggregates, graph and ordered kernels."""
