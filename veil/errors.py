"""Exceptions raised by the library."""


class LoadError(Exception):
    """A saved release could not be loaded (missing, corrupt, foreign or invalid bundle)."""
