"""Keyed hash tokens for random pseudonyms.

Each distinct value maps to ``"ID-" + n`` with ``n`` a 63-bit integer taken from
``sha256(secret | column | tagged value)``. Equal values share a token, columns are independent,
and no mapping table is built or shuffled: the token is a pure function of the row, so a retried
task recomputes the same tokens. With a fresh random secret that is never stored the tokens are
irreversible, like the reference's unseeded draws. Null is hashed as its own tagged value.

The secret enters the plan as an uncorrelated scalar subquery over a one-row DataFrame
(``secret_value``): Spark evaluates it once per query and no join is involved, while
``explain`` output and event logs show only ``Subquery``, never the secret itself.
"""

from __future__ import annotations

import secrets as _secrets

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import local_frame, nan_to_null
from .text import key_text

LONG_MAX = 9223372036854775807
# Token text is "ID-" followed by a non-negative 63-bit integer, as in the reference.
TOKEN_PREFIX = "ID-"


def new_secret() -> str:
    return _secrets.token_hex(16)


def secret_value(spark: SparkSession, secret: str) -> Column:
    """The secret as a scalar subquery: its value stays out of plan strings and event logs.

    The one-row table is a JVM-side local relation (see ``local_frame``), so evaluating the
    subquery starts no Python worker.
    """
    schema = T.StructType([T.StructField("secret", T.StringType())])
    return local_frame(spark, [(secret,)], schema).scalar()


def hash63(parts: list[Column], start: int = 1) -> Column:
    """63-bit non-negative integer from 16 hex digits of sha256 over ``parts`` joined by ``|``."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(h.substr(start, 16), 16, -10).cast("long").bitwiseAND(F.lit(LONG_MAX))


def pseudonym_token(c: Column, dtype: T.DataType, secret: Column, column: str, keep_nulls: bool = False) -> Column:
    """``secret``: a Column, normally ``secret_value(spark, text)``."""
    c = nan_to_null(c, dtype)
    tagged = F.when(c.isNull(), F.lit("n:")).otherwise(F.concat(F.lit("v:"), key_text(c, dtype)))
    token = F.concat(F.lit(TOKEN_PREFIX), hash63([secret, F.lit(column), tagged]).cast("string"))
    if keep_nulls:
        return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(token)
    return token
