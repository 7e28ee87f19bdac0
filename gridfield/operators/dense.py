"""Determinants and inverses of matrices over 4 x 4: LAPACK through numpy on Arrow batches, a batch of matrices a call.

Singular matrices: determinant 0, an inverse of NaN.  Null values stay null.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gridfield.field import Field

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _solve(n: int, is_complex: bool, what: str):
    parts = 2 if is_complex else 1

    def inverse(m):
        try:
            return np.linalg.inv(m)
        except np.linalg.LinAlgError:  # one of them is singular: each on its own
            out = np.full_like(m, np.nan)
            for k, x in enumerate(m):
                try:
                    out[k] = np.linalg.inv(x)
                except np.linalg.LinAlgError:
                    pass
            return out

    def task(batches):
        for batch in batches:
            values = batch.column(1)
            there = np.asarray(values.is_valid())
            flat = np.asarray(values.drop_null().flatten(), "f8").reshape(-1, n, n, parts)
            m = flat[..., 0] + 1j * flat[..., 1] if is_complex else flat[..., 0]
            done = np.linalg.det(m).reshape(-1, 1) if what == "determinant" else inverse(m).reshape(-1, n * n)
            numbers = np.stack([done.real, done.imag], -1).reshape(len(done), 2 * done.shape[1]) if is_complex else done
            rows, at = [None] * len(there), 0
            for k in np.flatnonzero(there):
                rows[k] = numbers[at]
                at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["site", "w"])

    return task


def _run(field: Field, what: str):
    n = field.shape[0]
    if field.shape != (n, n):
        raise ValueError("square matrices only")
    v = F.flatten(F.transform("v", lambda z: F.array(z["re"], z["im"]))) if field.complex else F.col("v")
    out = field.df.select("site", v.alias("w")).mapInArrow(_solve(n, field.complex, what), "site long, w array<double>")
    w, count = F.col("w"), n * n if what == "inverse" else 1
    if field.complex:
        pairs = F.array(*(F.struct(F.get(w, F.lit(2 * k)).alias("re"), F.get(w, F.lit(2 * k + 1)).alias("im")) for k in range(count)))
        w = F.when(w.isNotNull(), pairs)
    return out.select("site", (w if what == "inverse" else F.get(w, F.lit(0))).alias("v"))


def determinant(field: Field) -> Field:
    return Field(field.lattice, _run(field, "determinant"), (), field.complex)


def inverse(field: Field) -> Field:
    """Of any size; closed forms in ``algebra.inverse`` are for 4 x 4 and smaller."""
    return Field(field.lattice, _run(field, "inverse"), field.shape, field.complex, field.group)
