"""Base classes of visitors: what a search calls while it runs (:mod:`weftgraph.operators.traversal`).

A hook may raise StopSearch or PruneSearch. Edges are (src, dst, weight).
"""

from __future__ import annotations

from weftgraph.operators.kernels import PruneSearch, StopSearch

__all__ = ["BFSVisitor", "DFSVisitor", "DijkstraVisitor", "PruneSearch", "StopSearch"]


class _Visitor:
    def discover_vertex(self, node, *at):
        """A vertex is reached; ``at`` is its time or distance where the search has one."""

    def finish_vertex(self, node, *at):
        """All that leads on from a vertex was looked at."""


class BFSVisitor(_Visitor):
    def tree_edge(self, edge):
        """To a vertex that is new."""

    def non_tree_edge(self, edge):
        """To one that is not."""

    def gray_target_edge(self, edge):
        """To one that still waits."""

    def black_target_edge(self, edge):
        """To one that is finished."""


class DFSVisitor(_Visitor):
    def tree_edge(self, edge):
        """To a vertex that is new."""

    def back_edge(self, edge):
        """To one above it."""

    def forward_or_cross_edge(self, edge):
        """To one that is finished."""


class DijkstraVisitor(_Visitor):
    def examine_edge(self, edge):
        """An edge out of the vertex at hand."""

    def edge_relaxed(self, edge):
        """It shortens the way to its head."""

    def edge_not_relaxed(self, edge):
        """It does not."""
