"""Column metadata of a mixed-type table.

Order of ``columns`` is semantic: generated column *k* is conditioned on the
columns before it.  ``kind`` is one of continuous / integer / categorical;
``role`` is feature / target / label / covariate.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

KINDS = ("continuous", "integer", "categorical")
ROLES = ("feature", "target", "label", "covariate")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str = "continuous"
    role: str = "feature"
    min: float | None = None
    max: float | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.role not in ROLES:
            raise ValueError(f"unknown role {self.role!r}")


@dataclass(frozen=True)
class TableSpec:
    columns: tuple[ColumnSpec, ...]
    row_id: str = "row_id"
    meta: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def of(*cols, row_id: str = "row_id") -> "TableSpec":
        out = []
        for c in cols:
            if isinstance(c, ColumnSpec):
                out.append(c)
            elif isinstance(c, tuple):
                out.append(ColumnSpec(*c))
            else:
                out.append(ColumnSpec(c))
        return TableSpec(tuple(out), row_id=row_id)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def by_role(self, *roles) -> list[ColumnSpec]:
        return [c for c in self.columns if c.role in roles]

    @property
    def generated(self) -> list[ColumnSpec]:
        """Columns the flow generates: features and a target, in order."""
        return self.by_role("feature", "target")

    @property
    def label(self) -> ColumnSpec | None:
        ls = self.by_role("label")
        return ls[0] if ls else None

    @property
    def covariates(self) -> list[ColumnSpec]:
        return self.by_role("covariate")

    def kind_mask(self) -> list[bool]:
        """Categorical mask of the generated columns."""
        return [c.kind == "categorical" for c in self.generated]

    def get(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def with_roles(self, **roles) -> "TableSpec":
        cols = tuple(replace(c, role=roles.get(c.name, c.role)) for c in self.columns)
        return replace(self, columns=cols)
