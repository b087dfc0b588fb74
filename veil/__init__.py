"""veil: anonymize tables with Spark - pseudonyms, generalization, noise, masking, measures."""

from .errors import LoadError
from .metadata import CATEGORICAL, NUMERIC, Metadata
from .plans.release import Release
from .plans.workspace import Workspace
from .sources.bundle import load as load_release
from .sources.csv import read_csv, write_csv

__all__ = ["CATEGORICAL", "NUMERIC", "LoadError", "Metadata", "Release", "Workspace", "load_release", "read_csv",
           "write_csv"]
