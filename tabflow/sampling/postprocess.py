"""unscale -> decode categories -> round integers -> clip, one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encode
from ..spec import TableSpec


@dataclass
class Postprocessor:
    spec: TableSpec
    bounds: dict = field(default_factory=dict)        # raw (min, max) of numeric generated columns
    dictionaries: dict = field(default_factory=dict)  # categorical -> sorted values
    clip: dict = field(default_factory=dict)          # given (min, max): what values are clipped to, else ``bounds``
    types: dict = field(default_factory=dict)         # declared types; an integer column gets its own back

    @classmethod
    def fit(cls, df: DataFrame, spec: TableSpec, given_bounds: dict | None = None) -> "Postprocessor":
        gen = spec.generated
        num = [c.name for c in gen if c.kind != "categorical"]
        given = dict(given_bounds or {})
        for c in gen:
            if c.min is not None and c.max is not None:
                given.setdefault(c.name, (c.min, c.max))
        bounds = encode.data_bounds(df, num, given) if num else {}
        dicts = {c.name: encode.category_values(df, c.name) for c in gen if c.kind == "categorical"}
        return cls(spec, bounds, dicts)

    def finish(self, c, v):
        """Round, clip and restore the declared type of an unscaled numeric column."""
        if c.kind == "integer":
            v = encode.round_half_even(v)
        v = encode.clip_expr(v, *self.clip.get(c.name, self.bounds[c.name]))
        declared = self.types.get(c.name, "")
        return v.cast(declared) if c.kind == "integer" and declared in ("tinyint", "smallint", "int", "bigint") else v

    def transform(self, raw: DataFrame, dummy_coded: bool = False, round_codes: bool = False) -> DataFrame:
        """``raw``: scaled numeric columns; categorical columns as drop-first
        dummies (``dummy_coded``) or as integer codes (``round_codes`` rounds and
        clips codes first, the CS3F path).  Other columns pass through."""
        out = []
        used = set()
        for c in self.spec.generated:
            if c.kind == "categorical":
                vals = self.dictionaries[c.name]
                if dummy_coded:
                    names = [encode.dummy_name(c.name, v) for v in vals[1:]]
                    used.update(names)
                    out.append(encode.onehot_decode_expr(names, vals).alias(c.name))
                else:
                    code = F.col(c.name)
                    if round_codes:
                        code = encode.clip_expr(encode.round_half_even(code), 0, len(vals) - 1)
                    arr = F.array(*[F.lit(v) for v in vals])
                    out.append(F.element_at(arr, (code.cast("int") + 1)).alias(c.name))
                    used.add(c.name)
                continue
            mn, mx = self.bounds[c.name]
            out.append(self.finish(c, encode.unscale_expr(c.name, mn, mx)).alias(c.name))
            used.add(c.name)
        rest = [x for x in raw.columns if x not in used]
        lead = [x for x in rest if x in ("row_id",)]
        tail = [x for x in rest if x not in lead]
        return raw.select(*lead, *out, *tail)
