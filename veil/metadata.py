"""Column declarations and privacy roles, validated against a DataFrame's columns."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

# The two declared types and the metric weight of a sensitive column, as in the reference.
NUMERIC = "numeric"
CATEGORICAL = "categorical"
SENSITIVE_WEIGHT = 2.0
_TYPES = (NUMERIC, CATEGORICAL)


@dataclass(frozen=True, eq=True)
class Metadata:
    """Declared column types and roles.

    ``column_types`` maps a column to ``"numeric"`` or ``"categorical"``; columns left out count
    as categorical. A column may hold several roles. Quasi-identifiers are validated and kept
    but no operator consumes them.
    """

    column_types: Mapping[str, str] = field(default_factory=dict)
    identifiers: Sequence[str] = ()
    quasi_identifiers: Sequence[str] = ()
    sensitive_attributes: Sequence[str] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "column_types", dict(self.column_types))
        for name in ("identifiers", "quasi_identifiers", "sensitive_attributes"):
            value = getattr(self, name)
            if isinstance(value, str):
                raise TypeError(f"'{name}' must be a list of column names, not a string.")
            object.__setattr__(self, name, tuple(value))
        for col, typ in self.column_types.items():
            if typ not in _TYPES:
                raise ValueError(f"Column '{col}' has unknown declared type '{typ}'; use 'numeric' or 'categorical'.")

    def __hash__(self) -> int:  # column_types is a dict
        return hash((tuple(sorted(self.column_types.items())), self.identifiers,
                     self.quasi_identifiers, self.sensitive_attributes))

    # -- validation ---------------------------------------------------------------------------

    def validate(self, columns: Iterable[str]) -> None:
        """Every named column must exist (exact, case-sensitive match), else ``ValueError``."""
        defined = set(columns)
        for name in self.column_types:
            if name not in defined:
                raise ValueError(f"A declared type names '{name}', which is not a column of the table.")
        for name in (*self.identifiers, *self.quasi_identifiers, *self.sensitive_attributes):
            if name not in defined:
                raise ValueError(f"A role names '{name}', which is not a column of the table.")

    def select_identifiers(self, column: str | None) -> list[str]:
        if not self.identifiers:
            raise ValueError("The metadata declares no identifier columns.")
        if column is None:
            return list(self.identifiers)
        if column not in self.identifiers:
            raise ValueError(f"'{column}' is not declared as an identifier (identifiers: {list(self.identifiers)}).")
        return [column]

    def ensure_numeric(self, column: str) -> None:
        declared = self.column_types.get(column)
        if declared != NUMERIC:
            raise TypeError(f"'{column}' must be declared numeric for this operation (declared: {declared}).")

    def declared_type(self, column: str) -> str:
        return self.column_types.get(column, CATEGORICAL)

    @property
    def numeric_columns(self) -> list[str]:
        return [c for c, t in self.column_types.items() if t == NUMERIC]

    def weight(self, column: str) -> float:
        return SENSITIVE_WEIGHT if column in self.sensitive_attributes else 1.0

    # -- persistence --------------------------------------------------------------------------

    def to_dict(self) -> dict:
        return {
            "column_types": dict(self.column_types),
            "identifiers": list(self.identifiers),
            "quasi_identifiers": list(self.quasi_identifiers),
            "sensitive_attributes": list(self.sensitive_attributes),
        }

    @classmethod
    def from_dict(cls, d: Mapping) -> Metadata:
        return cls(
            column_types=d.get("column_types", {}),
            identifiers=d.get("identifiers", ()),
            quasi_identifiers=d.get("quasi_identifiers", ()),
            sensitive_attributes=d.get("sensitive_attributes", ()),
        )

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_json(cls, s: str) -> Metadata:
        return cls.from_dict(json.loads(s))
