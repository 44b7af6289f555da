"""All registered queries of the core and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from skyweave.plans import covisibility, evaluation, files, fits, flows, geometry, graph_edges, graphs, photos, reports, scenes, selections, sequences

_BOOKS = (covisibility.book, graph_edges.book, evaluation.book, graphs.book, photos.book, sequences.book, geometry.book, flows.book, reports.book, files.book, scenes.book, fits.book, selections.book)


def queries() -> dict[str, Callable]:
    return {name: f for b in _BOOKS for name, f in b.found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for b in _BOOKS for name, sql in b.sql.items()}
