"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from plateworks.plans import bundles, checks, evaluation, exports, graphs, kernels, measures, projected, recover, results, roundtrip, sampling, selection, serial, shapes, texts  # noqa: F401  they register
from plateworks.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
