"""Stateless anonymization of streaming DataFrames with batch-fitted models."""

from .models import BinModel, NoiseModel, mask_stream, pseudonymize_stream

__all__ = ["BinModel", "NoiseModel", "mask_stream", "pseudonymize_stream"]
