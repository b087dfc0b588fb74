"""Small helpers shared across modules: column quoting and type families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prefix of the hidden columns that keep a changed column's original value next to it.
ORIG_PREFIX = "__orig_"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def qcol(name: str) -> Column:
    """Reference a column by its exact name, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def orig_name(name: str) -> str:
    return ORIG_PREFIX + name


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    raise KeyError(f"No column named '{name}'.")


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL)


def family(dt: T.DataType) -> str:
    """Coarse type family used to decide whether two cells can ever be equal."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return dt.simpleString()


def is_hashable(dt: T.DataType) -> bool:
    """Whether Spark can hash the type: maps and variants can't be, anywhere inside."""
    if isinstance(dt, (T.MapType, T.VariantType)):
        return False
    if isinstance(dt, T.ArrayType):
        return is_hashable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(is_hashable(f.dataType) for f in dt.fields)
    return True


def nan_to_null(c: Column, dt: T.DataType) -> Column:
    """NaN is a missing value here, whatever layer is called."""
    return F.when(~F.isnan(c), c) if isinstance(dt, FRACTIONAL) else c


def reject_nested(dt: T.DataType, column: str) -> None:
    if isinstance(dt, NESTED):
        raise TypeError(f"Column '{column}' has nested type {dt.simpleString()}; only flat columns can be transformed.")


_ARROW_TYPES = {
    T.IntegerType: "int32", T.LongType: "int64", T.DoubleType: "float64", T.StringType: "string",
    T.BooleanType: "bool_",
}


def local_frame(spark, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small driver-side table (a handful of rows) as a JVM local relation.

    Built through Arrow, so using it never starts a Python worker; a plain list of tuples would
    become a Python RDD. Only for metadata-sized inputs (column lists, per-column summaries).
    """
    try:
        import pyarrow as pa
    except ImportError:  # pragma: no cover - pyarrow ships with pyspark[sql]
        return spark.createDataFrame(rows, schema)
    cols = {}
    for i, f in enumerate(schema.fields):
        pa_type = getattr(pa, _ARROW_TYPES[type(f.dataType)])()
        cols[f.name] = pa.array([r[i] for r in rows], type=pa_type)
    return spark.createDataFrame(pa.table(cols))
