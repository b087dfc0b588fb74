"""CSV source and sink.

Source: files are split among tasks, also where quoted fields span lines (``records``; one count of quotes
tells whether any does). ``multiLine=True`` leaves such files to Spark's own reader, one task a file, as do
encodings other than UTF-8. Rows shorter than the header are padded with NULL, longer ones
raise, and every file's own header must name the same columns in the same order. Every field is read
as text, the reference's missing-value tokens become NULL, then each
column is cast by its declared type (numeric -> long when every value is an integer, else double;
categorical -> text, which keeps codes like ``01234``). Undeclared columns are inferred the same
way plus booleans. One aggregate job checks all columns at once; pass ``schema=`` to skip it (missing
tokens become NULL with a schema too).

Sink: the working data as Python-style text (``True``, ``1e-05``, ``100000000.0``), header row, no
index, RFC-4180 quoting, a directory of part files written in parallel.
"""

from __future__ import annotations

import os
import re
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import qcol
from ..functions.text import py_str
from ..metadata import CATEGORICAL, NUMERIC, Metadata
from ..operators.numeric import NUMBER_TEXT
from . import records
from .records import literal

# The text tokens pandas.read_csv treats as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# The spellings pandas parses as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"

_READ_DEFAULTS = {"header": "true", "inferSchema": "false", "quote": '"', "escape": '"', "multiLine": "false"}
#: Holds a row's text where the parser found fewer or more fields than columns.
_CORRUPT = "__veil_row"


def _header(spark: SparkSession, path: str, opts: dict) -> list[str]:
    first = spark.read.options(**{**opts, "header": "false"}).csv(path).limit(1).collect()  # the header line only
    if not first:
        raise ValueError(f"CSV '{path}' is empty: no header row.")
    names = [v if v is not None else "" for v in first[0]]
    if not names:
        raise ValueError(f"CSV '{path}' has no columns.")
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise ValueError(f"CSV '{path}' has duplicate column names: {dupes}.")
    return names


def _text_rows(spark: SparkSession, path: str, names: list[str], opts: dict) -> DataFrame:
    """Every field as text with missing tokens as NULL, rows checked against the header."""
    fields = [T.StructField(n, T.StringType(), True) for n in names]
    sep, quote = opts.get("sep", opts.get("delimiter", ",")), opts["quote"]
    if opts["multiLine"].lower() != "true" and records.applies(opts) and records.spans_lines(spark, path, opts):
        raw = records.parsed(spark, path, names, opts, _CORRUPT)
    else:
        raw = spark.read.options(**{**opts, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT,
                                    "enforceSchema": "false"}).schema(
            T.StructType([*fields, T.StructField(_CORRUPT, T.StringType(), True)])).csv(path)
    row = qcol(_CORRUPT)
    # separators outside of quotes; an odd number of quotes means that a field goes on in the next line
    bare = F.regexp_replace(row, f"{literal(quote)}[^{literal(quote)}]*{literal(quote)}", "")
    too_long = F.size(F.split(bare, literal(sep), -1)) > len(names)
    open_quote = F.length(F.regexp_replace(row, f"[^{literal(quote)}]", "")) % 2 == 1
    problem = F.when(row.isNull(), None).when(
        open_quote, F.lit("a quoted field spans lines; read with multiLine=True")).when(
        too_long, F.lit("a row has more fields than the header"))

    def cell(n: str):
        bad = F.raise_error(F.concat(F.lit(f"CSV '{path}': "), problem)).cast("string")
        return F.when(problem.isNotNull(), bad).when(~qcol(n).isin(*NA_TOKENS), qcol(n)).alias(n)

    return raw.select(*[cell(n) for n in names])


def _as_type(f: T.StructField):
    """Text as the declared type; text that isn't of the type raises, as under ANSI casts."""
    c = qcol(f.name)
    if isinstance(f.dataType, T.StringType):
        return c
    return F.trim(c).cast(f.dataType)


def read_csv(spark: SparkSession, path: str, metadata: Metadata | None = None, *,
             schema: T.StructType | None = None, **options: str) -> DataFrame:
    opts = {**_READ_DEFAULTS, **{k: str(v) for k, v in options.items()}}
    if "sep" in options:
        opts["sep"] = options["sep"]
    names = _header(spark, path, opts)
    if schema is not None and [f.name for f in schema.fields] != names:
        raise ValueError(f"CSV '{path}' has the columns {names}, not those of the schema.")
    raw = _text_rows(spark, path, names, opts)
    if schema is not None:
        return raw.select(*[_as_type(f).alias(f.name) for f in schema.fields])
    declared = metadata.column_types if metadata else {}

    checks = []
    for i, n in enumerate(names):
        c = qcol(n)
        if declared.get(n) == CATEGORICAL:
            continue
        checks += [
            F.count_if(c.isNotNull() & ~(c.rlike(INTEGER_TEXT) & F.trim(c).try_cast("long").isNotNull())).alias(f"i{i}"),
            F.count_if(c.isNotNull() & ~c.rlike(NUMBER_TEXT)).alias(f"d{i}"),
            F.count_if(c.isNotNull() & ~c.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"b{i}"),
            F.count(c).alias(f"n{i}"),
        ]
    found = raw.agg(*checks).first() if checks else None

    cols = []
    for i, n in enumerate(names):
        c = qcol(n)
        kind = declared.get(n)
        if kind == CATEGORICAL:
            cols.append(c)
            continue
        non_int, non_num, non_bool, count = found[f"i{i}"], found[f"d{i}"], found[f"b{i}"], found[f"n{i}"]
        if kind == NUMERIC:
            if non_num:
                raise ValueError(f"Column '{n}' is declared numeric but holds {non_num} non-numeric value(s).")
            cols.append((F.trim(c).cast("long") if non_int == 0 else F.trim(c).cast("double")).alias(n))
        elif not count:
            cols.append(c.cast("double").alias(n))  # only missing values: a float column of NaN in pandas
        elif non_int == 0:
            cols.append(F.trim(c).cast("long").alias(n))
        elif non_num == 0:
            cols.append(F.trim(c).cast("double").alias(n))
        elif non_bool == 0:
            cols.append(c.isin(*TRUE_TOKENS).alias(n))
        else:
            cols.append(c)
    return raw.select(*cols)


# pandas.to_csv keyword -> Spark CSV writer option
_PANDAS_OPTIONS = {"sep": "sep", "na_rep": "nullValue", "quotechar": "quote", "lineterminator": "lineSep",
                   "encoding": "encoding", "compression": "compression", "header": "header"}
# The options that Spark documents for writing CSV.
_SPARK_OPTIONS = {
    "sep", "delimiter", "encoding", "charset", "quote", "quoteAll", "escape", "escapeQuotes", "header", "nullValue",
    "emptyValue", "compression", "codec", "dateFormat", "timestampFormat", "timestampNTZFormat",
    "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "charToEscapeQuoteEscaping", "lineSep", "locale",
}


def _input_roots(df: DataFrame) -> list[str]:
    try:
        return list(df.inputFiles())
    except Exception:  # noqa: BLE001 - sources without files (e.g. JDBC)
        return []


def _resolved(path: str) -> str:
    """The path part, decoded and absolute. Scheme and authority are left out, so that ``hdfs://nn/p``
    and ``/p`` count as the same place: refusing one time too often is the safe side."""
    uri = urlparse(path)
    name = unquote(uri.path) if uri.scheme and (uri.netloc or path.startswith(uri.scheme + ":/")) else path
    return os.path.realpath(os.path.abspath(name))


def _overlap(a: str, b: str) -> bool:
    return a == b or a.startswith(b.rstrip("/") + "/") or b.startswith(a.rstrip("/") + "/")


def _formatted(df: DataFrame, columns, float_format: str | None, date_format: str | None) -> list:
    names = list(df.columns if columns is None else columns)
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise KeyError(f"No columns named {missing}.")
    digits = re.fullmatch(r"%\.(\d+)f", float_format) if float_format is not None else None
    if float_format is not None and digits is None:
        raise ValueError("float_format takes the form '%.2f'.")
    out = []
    for f in (df.schema[c] for c in names):
        c = qcol(f.name)
        if digits and isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            # rounds the shortest decimal text of the number half to even
            n = int(digits[1])
            c = F.bround(c.cast("string").cast(T.DecimalType(38, min(18, n + 6))), n).cast(T.DecimalType(38, n)).cast("string")
        elif date_format is not None and isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, date_format)
        else:
            c = py_str(c, f.dataType)
        out.append(c.alias(f.name))
    return out


def write_csv(df: DataFrame, path: str, *, columns: list[str] | None = None, float_format: str | None = None,
              date_format: str | None = None, **options) -> None:
    """Write ``df`` as a directory of CSV parts.

    ``columns`` selects what is published, ``float_format`` (``"%.2f"``) and ``date_format`` (a Spark
    pattern) shape it. Other names are pandas' or Spark's writer options; any other name raises. A
    target that is, holds or lies under a file being read raises before anything is touched.
    """
    if options.pop("index", False):
        raise ValueError("A Spark DataFrame has no row index to export; leave 'index' unset or False.")
    quoting = options.pop("quoting", None)
    if quoting not in (None, 0, 1):
        raise ValueError("quoting takes 0 (minimal) or 1 (all).")
    opts = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}
    if quoting == 1:
        opts["quoteAll"] = "true"
    for k, v in options.items():
        name = _PANDAS_OPTIONS.get(k, k)
        if name not in _SPARK_OPTIONS:
            raise ValueError(f"Unknown export option '{k}'.")
        opts[name] = str(v).lower() if isinstance(v, bool) else str(v)
    target = _resolved(path)
    for f in map(_resolved, _input_roots(df)):
        folder, name = os.path.split(f)
        if _overlap(folder if name.startswith("part-") else f, target):  # parts belong to the folder's table
            raise ValueError(f"Refusing to overwrite '{path}': the data being written is read from there.")
    df.select(*_formatted(df, columns, float_format, date_format)).write.mode("overwrite").options(**opts).csv(path)
