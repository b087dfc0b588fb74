"""``Workspace``: a mutable handle with the reference's calling convention.

Code written against an in-place manager (``m.verb(...)`` returns nothing, later calls see the
change) can switch by constructing a ``Workspace`` instead; each verb swaps the current
immutable ``Release`` for the next one, so a failing call leaves the workspace unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..metadata import Metadata
from .release import Release

# verbs that produce a new release; the workspace keeps the result and returns None
_VERBS = (
    "random_pseudonyms", "deidentify_with_random_pseudonyms",
    "order_preserving_pseudonyms", "deidentify_with_order_preserving_pseudonyms",
    "reverse_pseudonyms", "reverse_order_preserving_pseudonyms",
    "generalize", "generalize_numeric_column",
    "perturb", "perturb_numeric_column",
    "mask", "mask_column",
    "reset", "reset_working_dataset",
    "checkpoint",
)
# read-only calls passed straight through
_QUERIES = (
    "metadata", "columns", "frame", "changed_columns", "ope_mapping_columns", "mapping",
    "original", "working", "get_original_dataset", "get_working_dataset", "preview", "count",
    "precision_privacy", "compute_precision_privacy_tradeoff", "statistics", "get_column_statistics",
    "export_csv", "export_working_to_csv", "save",
)


class Workspace:
    def __init__(self, df: DataFrame | None = None, metadata: Metadata | None = None, *,
                 release: Release | None = None, **kwargs):
        if release is None:
            if df is None or metadata is None:
                raise ValueError("Give a DataFrame and its metadata, or a release.")
            release = Release(df, metadata, **kwargs)
        self.release = release

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Workspace:
        return cls(release=Release.load(spark, path))

    def __getattr__(self, name):
        if name in _QUERIES:
            return getattr(self.release, name)
        if name in _VERBS:
            verb = getattr(self.release, name)

            def apply(*args, **kwargs) -> None:
                self.release = verb(*args, **kwargs)

            return apply
        raise AttributeError(name)

    def __dir__(self):
        return sorted(set(super().__dir__()) | set(_VERBS) | set(_QUERIES))
