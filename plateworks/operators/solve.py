"""Small systems of geometric constraints, solved for many groups at once by Gauss-Newton steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Kinds of constraints on the variables a, b, c and d of a group (places in its seed).
#: fix: a = value; gap: b - a = value; middle: c = (a + b) / 2 + value; distance: of (a, b) and (c, d) = value.
KINDS = ("fix", "gap", "middle", "distance")
STEPS, SMALL, MET = 50, 1e-9, 1e-6
CONSTRAINT = "struct<kind:string,a:int,b:int,c:int,d:int,value:double>"


def residuals(v: np.ndarray, kind: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, Jacobians) of stacked systems: v (groups, variables), kind (groups, constraints), at (groups, constraints, 4), value."""
    g, m = np.arange(len(v))[:, None], kind.shape[1]
    x = v[g[:, :, None], at]
    a, b, c, d = (x[..., i] for i in range(4))
    dx, dy = c - a, d - b
    far = np.hypot(dx, dy)
    with np.errstate(invalid="ignore", divide="ignore"):
        ux, uy = np.where(far > 0, dx / far, 0.0), np.where(far > 0, dy / far, 0.0)
    one, zero = np.ones_like(a), np.zeros_like(a)
    r = np.choose(kind, [a - value, b - a - value, c - (a + b) / 2 - value, far - value])
    parts = [np.choose(kind, p) for p in ([one, -one, -one / 2, -ux], [zero, one, -one / 2, -uy], [zero, zero, one, ux], [zero, zero, zero, uy])]
    j = np.zeros((len(v), m, v.shape[1]))
    for i, p in enumerate(parts):
        np.add.at(j, (g, np.arange(m)[None, :], at[..., i]), p)
    return r, j


def solved(seed: np.ndarray, kind: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(variables, norm of the residuals, rank, steps) of stacked systems of one shape.

    A step is the shortest that solves the linear system best, so what no constraint fixes stays where its seed is.
    """
    v, steps, open_ = seed.copy(), np.zeros(len(seed), int), np.arange(len(seed))
    for _ in range(STEPS):
        r, j = residuals(v[open_], kind[open_], at[open_], value[open_])
        d = -np.matmul(np.linalg.pinv(j, rcond=1e-12), r[..., None])[..., 0]
        v[open_] += d
        steps[open_] += 1
        open_ = open_[np.linalg.norm(d, axis=1) >= SMALL]
        if not len(open_):
            break
    r, j = residuals(v, kind, at, value)
    return v, np.linalg.norm(r, axis=1), np.linalg.matrix_rank(j, tol=1e-9) if j.size else np.zeros(len(v), int), steps


def solve(df: DataFrame, seed: str = "seed", constraints: str = "constraints", out: str = "solution") -> DataFrame:
    """df (a system a row: seed array<double>, constraints array<CONSTRAINT>) with ``out``: struct<status, values, residual, rank, steps>.

    solved: all constraints are met and all variables fixed; free: met, but the rank is less than the number of variables, of which those not
    fixed stay near their seeds; unmet: no step helps and a residual is left (contradictory constraints give the least squares);
    invalid: nulls, unknown kinds or places outside the seed, without values. A batch's systems of one shape are solved in one call.
    """
    kind = T._parse_datatype_string("status string, values array<double>, residual double, rank int, steps int")
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, kind)])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[dict | None] = [None] * batch.num_rows
            shapes: dict[tuple[int, int], list[int]] = {}
            systems = list(zip(batch.column(seed).to_pylist(), batch.column(constraints).to_pylist(), strict=True))
            for i, (s, cs) in enumerate(systems):
                if _valid(s, cs):
                    shapes.setdefault((len(s), len(cs)), []).append(i)
                else:
                    made[i] = {"status": "invalid", "values": None, "residual": None, "rank": None, "steps": None}
            for (n, m), mine in shapes.items():
                cs = [systems[i][1] for i in mine]
                codes = np.array([[KINDS.index(c["kind"]) for c in row] for row in cs], int).reshape(len(mine), m)
                at = np.array([[[c[k] if c[k] is not None else 0 for k in "abcd"] for c in row] for row in cs], int).reshape(len(mine), m, 4)
                value = np.array([[c["value"] for c in row] for row in cs], float).reshape(len(mine), m)
                v, r, rank, steps = solved(np.array([systems[i][0] for i in mine], float).reshape(len(mine), n), codes, at, value)
                for i, *x in zip(mine, v.tolist(), r.tolist(), rank.tolist(), steps.tolist(), strict=True):
                    status = "unmet" if not x[1] <= MET else "free" if x[2] < n else "solved"
                    made[i] = {"status": status, "values": x[0], "residual": x[1], "rank": x[2], "steps": x[3]}
            column = pa.array(made, pa.struct([("status", pa.string()), ("values", pa.list_(pa.float64())), ("residual", pa.float64()), ("rank", pa.int32()), ("steps", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), column], names=[*names, out])

    return df.mapInArrow(run, schema)


def _valid(seed: list | None, constraints: list | None) -> bool:
    if seed is None or constraints is None or any(x is None or not np.isfinite(x) for x in seed):
        return False
    used = {"fix": "a", "gap": "ab", "middle": "abc", "distance": "abcd"}
    for c in constraints:
        if c is None or c["kind"] not in used or c["value"] is None or not np.isfinite(c["value"]):
            return False
        if any(c[k] is None or not 0 <= c[k] < len(seed) for k in used[c["kind"]]) or any(c[k] is not None and not 0 <= c[k] < len(seed) for k in "abcd"):
            return False
    return bool(seed)
