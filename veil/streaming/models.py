"""Anonymize streaming DataFrames.

Masking and random pseudonyms are row-local expressions and apply to a stream as they are.
Generalization and perturbation need the column's range, which a stream never finishes; fit it
on a batch (``BinModel.fit`` / ``NoiseModel.fit``) and apply the fitted model to each micro-batch.
Values outside the fitted range fall into the end bins (generalize) or are clipped (perturb). No
state, watermark or shuffle is involved, so these run in append mode on any source.
Rank pseudonyms, the metric and statistics need the whole table: run them per micro-batch via
``foreachBatch`` if needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .._util import dtype_of, qcol
from ..functions import binning
from ..functions.hashing import new_secret, pseudonym_token, secret_value
from ..functions.noise import keyed_standard_normal
from ..functions.text import key_text
from ..operators import generalize as gen
from ..operators import mask as msk
from ..operators import perturb as ptb
from ..operators.numeric import Range


@dataclass(frozen=True)
class BinModel:
    column: str
    bins: binning.Bins
    rounding: str = "half_even"

    @classmethod
    def fit(cls, df: DataFrame, column: str, bins: int = 10, include_lowest: bool = True,
            rounding: str = "half_even") -> BinModel:
        return cls(column, gen.fit_bins(df, column, bins, include_lowest), rounding)

    def transform(self, df: DataFrame) -> DataFrame:
        dt = dtype_of(df, self.column)
        return df.withColumn(self.column, gen.generalized(qcol(self.column), dt, self.bins, self.rounding, clamp=True))


@dataclass(frozen=True)
class NoiseModel:
    column: str
    range: Range
    noise_std: float
    seed: int
    key: tuple[str, ...]

    @classmethod
    def fit(cls, df: DataFrame, column: str, key: list[str], noise_std: float = 0.05,
            random_state: int | None = None) -> NoiseModel:
        ptb.check_noise(noise_std)
        if not key:
            raise ValueError("A stream needs explicit key columns for keyed noise.")
        return cls(column, ptb.fit_perturb_range(df, column), noise_std, ptb.draw_seed(random_state), tuple(key))

    def transform(self, df: DataFrame) -> DataFrame:
        dt = dtype_of(df, self.column)
        seed = secret_value(df.sparkSession, str(self.seed))
        z = keyed_standard_normal(seed, self.column, [key_text(qcol(k), dtype_of(df, k)) for k in self.key])
        return df.withColumn(self.column, ptb.perturbed(qcol(self.column), dt, self.range, self.noise_std, z))


def mask_stream(df: DataFrame, column: str, strategy: str, k: int | None = None,
                regex_pattern: str | None = None) -> DataFrame:
    return msk.mask(df, column, strategy, k, regex_pattern)


def pseudonymize_stream(df: DataFrame, columns: list[str], secret: str | None = None,
                        keep_nulls: bool = False) -> DataFrame:
    """Keyed tokens; pass the same ``secret`` across restarts to keep tokens stable."""
    key = secret_value(df.sparkSession, secret or new_secret())
    return df.withColumns({c: pseudonym_token(qcol(c), dtype_of(df, c), key, c, keep_nulls) for c in columns})
