"""The masking strategies and keyed pseudonyms as SQL functions, for ``spark.sql`` users.

Registered as temporary SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN <expr>``): they
are inlined into the plan as native expressions, no Python worker is involved. Nulls are guarded
explicitly because ``least`` skips them (a null string must never size a ``repeat``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .._util import local_frame
from .hashing import new_secret

#: One-row view that holds the pseudonym secret; as data, it shows in no plan or event log.
SECRET_VIEW = "veil_secret"

_FUNCTIONS = {
    "veil_mask_first_k": (
        "s STRING, k INT",
        "CASE WHEN s IS NULL THEN NULL ELSE concat(repeat('*', least(k, char_length(s))), "
        "substr(s, least(k, char_length(s)) + 1)) END",
    ),
    "veil_mask_last_k": (
        "s STRING, k INT",
        "CASE WHEN s IS NULL THEN NULL WHEN char_length(s) <= k THEN repeat('*', char_length(s)) "
        "ELSE concat(substr(s, 1, char_length(s) - k), repeat('*', least(k, char_length(s)))) END",
    ),
    "veil_mask_before_first_space": (
        "s STRING",
        "CASE WHEN instr(s, ' ') = 0 THEN s ELSE concat(repeat('*', instr(s, ' ') - 1), substr(s, instr(s, ' '))) END",
    ),
    "veil_mask_after_last_space": (
        "s STRING",
        "CASE WHEN instr(s, ' ') = 0 THEN s ELSE concat(substr(s, 1, char_length(s) - "
        "char_length(substring_index(s, ' ', -1))), repeat('*', char_length(substring_index(s, ' ', -1)))) END",
    ),
    "veil_pseudonym": (
        "v STRING, col STRING",
        f"concat('ID-', CAST(CAST(conv(substr(sha2(concat_ws('|', (SELECT first(secret) FROM {SECRET_VIEW}), col, "
        "CASE WHEN v IS NULL THEN 'n:' ELSE concat('v:', v) END), 256), 1, 16), 16, -10) AS BIGINT) "
        "& 9223372036854775807 AS STRING))",
    ),
}


def register_sql_functions(spark: SparkSession, secret: str | None = None) -> list[str]:
    """Create the temporary SQL functions in ``spark``; returns their names.

    ``secret`` (fresh and unknown if None) keys ``veil_pseudonym(value, column_name)``. It is kept in a
    one-row view of this session and never is a literal of a query.

    Regex masking needs no function of its own: ``regexp_replace(s, '(?U)<pattern>', '*')``.
    """
    schema = T.StructType([T.StructField("secret", T.StringType())])
    local_frame(spark, [(secret or new_secret(),)], schema).createOrReplaceTempView(SECRET_VIEW)
    for name, (params, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS STRING RETURN {body}")
    return list(_FUNCTIONS)
