"""All registered queries; importing the section modules fills the registry."""

from __future__ import annotations

from . import q_basic, q_checked, q_draws, q_flow_values, q_metrics, q_models, q_sparse, q_stream  # noqa: F401
from .registry import HEADLINE, ORACLE, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    """Share of real orders covered by independent-marginal synthetic orders."""
    from .q_metrics import flagship as _flagship
    return _flagship(spark, sf_dir)
