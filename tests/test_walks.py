"""Walks over parents against plain Python."""

from plateworks.operators import graph
from plateworks.plans import catalogue


def ends(parent, at):
    """Steps to the end, or None in or into a cycle."""
    seen, n = set(), 0
    while at is not None:
        if at in seen:
            return None
        seen.add(at)
        at = parent.get(at)
        n += at is not None
    return n


def test_walks_stop_only_at_a_repeat(spark):
    parent = {i: i + 1 for i in range(50)} | {50: None}  # a chain of 50 steps that ends
    parent |= {100 + i: 100 + i + 1 for i in range(20)}  # one that ends at a parent that is no node
    parent |= {200: 201, 201: 202, 202: 200, 203: 200, 204: 203, 300: 300, 301: 300}
    got = {r.id: (r.depth, r.in_cycle) for r in graph.walks(spark.createDataFrame(list(parent.items()), "id long, parent long")).collect()}
    want = {i: ends(parent, i) for i, p in parent.items() if p is not None}
    assert got == {i: (d, d is None) for i, d in want.items()}


def test_parent_cycle_all_flags_no_long_chain(spark, tmp_path):
    spark.range(1000).toDF("s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    parent = {i: (i * 3 + 1) % 100 if i % 7 else None for i in range(1000)}
    rows = catalogue.queries()["parent_cycle_all"](spark, str(tmp_path)).collect()
    assert {r.id: r.depth for r in rows} == {i: ends(parent, i) for i, p in parent.items() if p is not None}
    assert max(r.depth or 0 for r in rows) > 12 and any(r.in_cycle for r in rows)
