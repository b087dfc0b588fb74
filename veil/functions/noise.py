"""Gaussian noise as native expressions.

Keyed noise: two uniforms from 48-bit slices of ``sha256(seed | column | key...)`` (each key part
length-prefixed, so the input is injective) and a Box-Muller transform. It depends only on the
row's key, so it is the same under any partitioning, ordering or task retry - unlike Spark's
``randn(seed)``, which is seeded per partition and follows row order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO48 = float(2 ** 48)


def _u48(h: Column, start: int) -> Column:
    return (F.conv(h.substr(start, 12), 16, 10).cast("long").cast("double") + 0.5) / _TWO48


def keyed_standard_normal(seed: Column, column: str, keys: list[Column]) -> Column:
    """``seed``: a text Column, normally ``hashing.secret_value(spark, str(seed))`` so the seed never
    shows in plans (with it and the output, the noise could be subtracted again).
    ``keys`` are text columns (see ``text.key_text``)."""
    # each key part as "<length>:<text>" (null: "-") so no two different keys give the same input
    parts = [seed, F.lit(column)] + [
        F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in keys
    ]
    h = F.sha2(F.concat_ws("|", *parts), 256)
    u1 = _u48(h, 1)
    u2 = _u48(h, 13)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def row_fingerprint(cols: list[Column]) -> list[Column]:
    """A 96-bit fingerprint of whole rows (``xxhash64`` and 32-bit ``hash``) as key text.

    Used when noise is keyed by the entire row: hashing a fingerprint keeps the sha256 input
    short however wide the row (long texts), at a collision chance of about n^2 / 2^97.
    """
    if not cols:
        raise ValueError("A row without hashable columns has no fingerprint; pass a key.")
    return [F.concat(F.xxhash64(*cols).cast("string"), F.lit("/"), F.hash(*cols).cast("string"))]
