"""``Release``: an immutable handle over a table being anonymized.

The reference keeps two in-memory copies (original and working) and mutates the working one.
Spark rows have no position, and the metric must compare each cell with its original, so a
``Release`` keeps ONE DataFrame (``frame``) that holds the working columns under their own names
plus ``__orig_<c>`` for every column changed so far. Every operation is a row-preserving
projection or a left join on a unique key, so the pairing holds by construction and the metric
needs no join. Each verb returns a new ``Release``; nothing runs until an action, apart from the
small fitting jobs some verbs need (min/max, the rank table).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import ORIG_PREFIX, dtype_of, is_hashable, orig_name, qcol, reject_nested
from ..functions.hashing import new_secret, pseudonym_token, secret_value
from ..functions.noise import keyed_standard_normal, row_fingerprint
from ..functions.text import key_text
from ..metadata import Metadata
from ..operators import generalize as gen
from ..operators import mask as msk
from ..operators import perturb as ptb
from ..operators import pseudonyms as ps
from ..operators.metrics import observed_precision, precision_privacy
from ..operators.positions import PLACE, with_places
from ..operators.statistics import column_statistics
from ..session import ensure_checkpoint_dir
from .ranking import RankTable, materialize, release_scratch

DISPLAY_ROUNDED = ("mean", "min", "max", "std", "median")


@dataclass(frozen=True)
class RankMapping:
    """A stored order-preserving mapping ``(value, rank)`` for one column."""

    ranks: RankTable
    original_type: T.DataType
    version: int
    from_original: bool = False  # ranked straight from the original values (the column was unchanged)
    before: DataFrame | None = None  # the paired frame just before and just after ranking, and the
    after: DataFrame | None = None  # column's change counter then: reversing at once returns to it
    prior: int | None = None

    @property
    def table(self) -> DataFrame:
        return self.ranks.table


def _normalize(df: DataFrame) -> DataFrame:
    """NaN is a missing value to the reference; make it SQL NULL so counts and equality agree."""
    updates = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = qcol(f.name)
            updates[f.name] = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
    return df.withColumns(updates) if updates else df


def _check_columns(df: DataFrame) -> None:
    names = df.columns
    if len(set(names)) != len(names):
        raise ValueError("Column names must be unique.")
    case_sensitive = str(df.sparkSession.conf.get("spark.sql.caseSensitive", "false")).lower() == "true"
    if not case_sensitive and len({n.lower() for n in names}) != len(names):
        raise ValueError("Column names differ only by case; Spark resolves them as one. "
                         "Rename them or set spark.sql.caseSensitive=true.")
    for n in names:
        if n.startswith(ORIG_PREFIX):
            raise ValueError(f"Column '{n}' uses the reserved prefix '{ORIG_PREFIX}'.")


@dataclass(frozen=True)
class _State:
    source: DataFrame
    frame: DataFrame
    metadata: Metadata
    columns: tuple[str, ...]
    versions: dict = field(default_factory=dict)  # column -> change counter (present = changed)
    mappings: dict = field(default_factory=dict)  # column -> RankMapping, in application order


class Release:
    """Original and working views of one table plus metadata and reversible mappings."""

    def __init__(self, df: DataFrame, metadata: Metadata, *, snapshot: bool = False, file_order: bool = False):
        """``file_order`` keeps each row's place in the files ``df`` is read from (hidden, like the originals),
        so that previews and exports can follow it."""
        _check_columns(df)
        metadata.validate(df.columns)
        src = _normalize(with_places(df) if file_order else df)
        if snapshot:
            ensure_checkpoint_dir(df.sparkSession)
            src = src.checkpoint(eager=True)
        self._s = _State(src, src, metadata, tuple(df.columns))

    @classmethod
    def from_pandas(cls, spark, pdf, metadata: Metadata, schema=None, **kwargs) -> Release:
        """A release over a pandas DataFrame (shipped to the cluster through Arrow)."""
        return cls(spark.createDataFrame(pdf, schema=schema), metadata, **kwargs)

    @classmethod
    def _from_state(cls, state: _State) -> Release:
        obj = cls.__new__(cls)
        obj._s = state
        return obj

    def __repr__(self) -> str:
        return (f"Release(columns={list(self._s.columns)}, changed={self.changed_columns}, "
                f"rank_mappings={self.ope_mapping_columns}, streaming={self._s.frame.isStreaming})")

    # -- accessors ----------------------------------------------------------------------------

    @property
    def metadata(self) -> Metadata:
        return self._s.metadata

    @property
    def columns(self) -> list[str]:
        return list(self._s.columns)

    @property
    def frame(self) -> DataFrame:
        """Paired frame: working columns plus ``__orig_<c>`` for changed columns (never export it)."""
        return self._s.frame

    @property
    def changed_columns(self) -> list[str]:
        return [c for c in self._s.columns if c in self._s.versions]

    @property
    def ope_mapping_columns(self) -> list[str]:
        return list(self._s.mappings)

    def mapping(self, column: str) -> DataFrame:
        return self._s.mappings[column].table

    @property
    def in_file_order(self) -> bool:
        return set(PLACE) <= set(self._s.frame.columns)

    def original(self) -> DataFrame:
        return self._s.source.select(*[qcol(c) for c in self._s.columns])

    def working(self) -> DataFrame:
        return self._s.frame.select(*[qcol(c) for c in self._s.columns])

    get_original_dataset = original
    get_working_dataset = working

    def reset(self) -> Release:
        """Working := original, mappings cleared."""
        s = self._s
        return Release._from_state(_State(s.source, s.source, s.metadata, s.columns))

    reset_working_dataset = reset

    def preview(self, n: int = 20, use_working: bool = True, order_by: list[str] | None = None) -> DataFrame:
        """First ``n`` rows: by ``order_by``, else in file order if the release keeps it (a top-n, not a full
        sort), else any."""
        if not isinstance(n, int) or n < 1:
            raise ValueError("n must be a positive integer.")
        df = self._s.frame if use_working else self._s.source
        order = list(order_by or (PLACE if self.in_file_order else ()))
        if order:
            df = df.orderBy(*[qcol(c) for c in order])
        return df.limit(n).select(*[qcol(c) for c in self._s.columns])

    def checkpoint(self) -> Release:
        """Cut the lineage of a long chain of verbs: write the paired frame as parquet in the shared
        checkpoint folder and continue from it. Original, working, mappings and metric are unchanged."""
        frame = materialize(self._s.frame, "release")
        cols = self._s.columns
        source = frame.select(*[(qcol(orig_name(c)) if c in self._s.versions else qcol(c)).alias(c) for c in cols],
                              *(PLACE if self.in_file_order else ()))
        return Release._from_state(replace(self._s, frame=frame, source=source))

    def count(self) -> int:
        """Row count; every verb keeps rows one-to-one, so the source answers without any join."""
        return self._s.source.count()

    # -- internal -----------------------------------------------------------------------------

    def _ensure_column(self, column: str) -> T.DataType:
        if column not in self._s.columns:
            raise KeyError(f"No column named '{column}'.")
        dt = dtype_of(self._s.frame, column)
        reject_nested(dt, column)
        return dt

    def _with_originals(self, frame: DataFrame, columns: list[str]) -> DataFrame:
        new = {orig_name(c): qcol(c) for c in columns if c not in self._s.versions}
        return frame.withColumns(new) if new else frame

    def _bump(self, columns: list[str]) -> dict:
        v = dict(self._s.versions)
        for c in columns:
            v[c] = v.get(c, 0) + 1
        return v

    def _replace(self, updates: dict[str, Column], mappings: dict | None = None) -> Release:
        frame = self._with_originals(self._s.frame, list(updates))
        frame = frame.withColumns(updates)
        return Release._from_state(replace(
            self._s, frame=frame, versions=self._bump(list(updates)),
            mappings=self._s.mappings if mappings is None else mappings,
        ))

    def _batch_only(self, verb: str) -> None:
        if self._s.frame.isStreaming:
            raise TypeError(f"'{verb}' needs the whole table; on a stream use veil.streaming "
                            "(BinModel / NoiseModel fitted on a batch) or run it per micro-batch via foreachBatch.")

    def _fit_input(self, column: str) -> DataFrame:
        """Where to fit a column: the source while it is unchanged (skips joins added by earlier verbs)."""
        return self._s.source if column not in self._s.versions else self._s.frame

    def _original_type(self, column: str) -> T.DataType:
        return dtype_of(self._s.source, column)

    def _original_value(self, column: str) -> Column:
        return qcol(orig_name(column)) if column in self._s.versions else qcol(column)

    # -- de-identification --------------------------------------------------------------------

    def random_pseudonyms(self, identifier_column: str | None = None, *, secret: str | None = None,
                          keep_nulls: bool = False) -> Release:
        cols = self.metadata.select_identifiers(identifier_column)
        updates = {}
        for c in cols:
            dt = self._ensure_column(c)
            key = secret_value(self._s.frame.sparkSession, secret or new_secret())
            updates[c] = pseudonym_token(qcol(c), dt, key, c, keep_nulls)
        return self._replace(updates)

    deidentify_with_random_pseudonyms = random_pseudonyms

    def order_preserving_pseudonyms(self, identifier_column: str | None = None) -> Release:
        cols = self.metadata.select_identifiers(identifier_column)
        state = self
        for c in cols:
            state = state._ope_one(c)
        return state

    deidentify_with_order_preserving_pseudonyms = order_preserving_pseudonyms

    def _ope_one(self, c: str) -> Release:
        self._batch_only("order_preserving_pseudonyms")
        dt = self._ensure_column(c)
        mapping = ps.rank_mapping(self._fit_input(c), c)
        before = self._s.frame
        frame = ps.apply_rank_mapping(self._with_originals(before, [c]), c, mapping)
        versions = self._bump([c])
        mappings = {k: v for k, v in self._s.mappings.items() if k != c}
        # re-application replaces the old mapping
        mappings[c] = RankMapping(mapping, dt, versions[c], from_original=c not in self._s.versions,
                                  before=before, after=frame, prior=self._s.versions.get(c))
        return Release._from_state(replace(self._s, frame=frame, versions=versions, mappings=mappings))

    def reverse_pseudonyms(self, identifier_column: str | None = None, *, force: bool = False) -> Release:
        """Restore ranked columns from their stored mapping, then drop the mapping.

        Raises if the column changed after it was ranked (the mapping would mis-map
        coincidental values) unless ``force``.
        """
        if identifier_column is None:
            cols = list(self._s.mappings)
        else:
            if identifier_column not in self.metadata.identifiers:
                raise ValueError(f"'{identifier_column}' is not declared as an identifier.")
            if identifier_column not in self._s.mappings:
                raise ValueError(
                    f"'{identifier_column}' has no stored rank mapping to reverse; "
                    "rank it with order_preserving_pseudonyms first."
                )
            cols = [identifier_column]
        for c in cols:
            m = self._s.mappings[c]
            if m.version != self._s.versions.get(c) and not force:
                raise ValueError(
                    f"Column '{c}' changed after it was pseudonymized; pass force=True to reverse anyway."
                )
        frame, versions = self._s.frame, dict(self._s.versions)
        for c in reversed(cols):
            m = self._s.mappings[c]
            if m.after is not None and m.after is frame:
                # nothing followed the ranking: go back to the frame before it, and so to its plan
                frame = m.before
                versions.pop(c)
                if m.prior is not None:
                    versions[c] = m.prior
                continue
            versions[c] = versions.get(c, 0) + 1
            if m.from_original and m.version == self._s.versions.get(c):
                # the ranks were taken from the original values and nothing changed since: the paired
                # frame still holds those values, so reversing is a projection - no join, no shuffle
                frame = frame.withColumn(c, qcol(orig_name(c)))
            else:
                frame = ps.reverse_rank_mapping(frame, c, m.ranks, m.original_type)
        mappings = {k: v for k, v in self._s.mappings.items() if k not in cols}
        return Release._from_state(replace(self._s, frame=frame, versions=versions, mappings=mappings))

    reverse_order_preserving_pseudonyms = reverse_pseudonyms

    def close(self) -> None:
        """Delete the rank tables in the scratch folder: they are the key that reverses pseudonyms.

        Call it when the release is written. Handles with ranked columns that were not checkpointed
        or saved can't be computed any more; saved bundles keep their own copy of the mapping.
        """
        for m in self._s.mappings.values():
            release_scratch(m.ranks.data, "ranks-")

    # -- numeric anonymization ----------------------------------------------------------------

    def generalize(self, column: str, bins: int = 10, include_lowest: bool = True,
                   rounding: str = "half_even") -> Release:
        dt = self._ensure_column(column)
        self.metadata.ensure_numeric(column)
        self._batch_only("generalize")
        b = gen.fit_bins(self._fit_input(column), column, bins, include_lowest)
        return self._replace({column: gen.generalized(qcol(column), dt, b, rounding)})

    generalize_numeric_column = generalize

    def perturb(self, column: str, noise_std: float = 0.05, random_state: int | None = None,
                key: list[str] | None = None) -> Release:
        """Noise is a function of (seed, column, key): identical on any partitioning and on retry.

        ``key`` defaults to the whole original row: an identifier need not be unique, and rows that
        share their noise give away their exact differences. Name a ``key`` only if it is unique.
        """
        dt = self._ensure_column(column)
        self.metadata.ensure_numeric(column)
        ptb.check_noise(noise_std)
        self._batch_only("perturb")
        r = ptb.fit_perturb_range(self._fit_input(column), column)
        keys = list(key or [])
        for k in keys:
            if k not in self._s.columns:
                raise KeyError(f"No key column named '{k}'.")
        if noise_std == 0:
            z = F.lit(0.0)
        else:
            if keys:
                texts = [key_text(self._original_value(k), self._original_type(k)) for k in keys]
            else:  # the whole original row, through a short fingerprint
                texts = row_fingerprint([self._original_value(c) for c in self._s.columns
                                         if is_hashable(self._original_type(c))])
            z = keyed_standard_normal(ptb.seed_value(self._s.frame.sparkSession, random_state), column, texts)
        return self._replace({column: ptb.perturbed(qcol(column), dt, r, noise_std, z)})

    perturb_numeric_column = perturb

    def mask(self, column: str, strategy: str, k: int | None = None, regex_pattern: str | None = None) -> Release:
        dt = self._ensure_column(column)
        java = msk.validate(strategy, k, regex_pattern, self._s.frame.sparkSession)
        return self._replace({column: msk.masked(qcol(column), dt, strategy, k, java)})

    mask_column = mask

    # -- measures -----------------------------------------------------------------------------

    def precision_privacy(self, digits: int | None = None) -> DataFrame:
        """One row ``(precision_pct, privacy_pct)``; ``digits=1`` gives the reference UI's display."""
        out = precision_privacy(self._s.frame, list(self._s.columns), set(self._s.versions), self.metadata)
        if digits is None:
            return out
        return out.select(*[F.round(c, digits).alias(c) for c in out.columns])

    def compute_precision_privacy_tradeoff(self) -> tuple[float, float]:
        r = self.precision_privacy().first()
        return float(r["precision_pct"]), float(r["privacy_pct"])

    def statistics(self, use_working: bool = True, approx: bool = False, digits: int | None = None) -> DataFrame:
        """One row per column; ``digits=4`` rounds the five numeric statistics as the reference UI shows them."""
        self._batch_only("statistics")
        df = self.working() if use_working else self.original()
        out = column_statistics(df, self.metadata, approx=approx)
        if digits is None:
            return out
        return out.select(*[F.round(c, digits).alias(c) if c in DISPLAY_ROUNDED else F.col(c) for c in out.columns])

    get_column_statistics = statistics

    # -- persistence and export ---------------------------------------------------------------

    def export_csv(self, path: str, **options) -> None:
        """CSV parts of the working view. A release that keeps the file order writes its rows in that order: sorted
        by range in parallel, and the parts' names ascend with it."""
        from ..sources.csv import write_csv
        if self.in_file_order:
            cols = self._s.columns
            write_csv(self._s.frame.orderBy(*PLACE).select(*[qcol(c) for c in cols]), path, **options)
        else:
            write_csv(self.working(), path, **options)

    export_working_to_csv = export_csv

    def save(self, path: str, keep: int | None = None) -> str:
        """Write a version of the bundle; ``keep=n`` deletes all but the newest n complete versions."""
        from ..sources.bundle import save
        return save(self, path, keep)

    def export_with_metric(self, path: str, **options) -> DataFrame:
        """``export_csv`` and the row ``(precision_pct, privacy_pct)`` from one run: cells are counted while they are
        written (observed metrics of the writing stage, which count each partition once also when a task is retried)."""
        from ..sources.csv import write_csv
        cols = list(self._s.columns)
        frame = self._s.frame.orderBy(*PLACE) if self.in_file_order else self._s.frame
        frame, finish = observed_precision(frame, cols, set(self._s.versions), self.metadata)
        write_csv(frame.select(*[qcol(c) for c in cols]), path, **options)
        return finish()

    @classmethod
    def load(cls, spark, path: str) -> Release:
        from ..sources.bundle import load
        return load(spark, path)
