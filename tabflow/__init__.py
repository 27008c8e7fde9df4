"""tabflow: mixed-type table synthesis with flow matching on boosted trees, on Spark."""

__version__ = "0.1.0"

__all__ = ["TableSpec", "ColumnSpec", "SequentialFlow", "JointFlow", "BoostParams", "load_dataset"]


def __getattr__(name):
    if name in ("TableSpec", "ColumnSpec"):
        from . import spec
        return getattr(spec, name)
    if name in ("SequentialFlow", "JointFlow"):
        from .learners import flows
        return getattr(flows, name)
    if name == "BoostParams":
        from .learners.hist_boost import BoostParams
        return BoostParams
    if name == "load_dataset":
        from .sources.registry import load_dataset
        return load_dataset
    raise AttributeError(name)
