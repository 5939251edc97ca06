"""Every operator as a named query over the test tables, with its SQL twin."""

from voxboard.catalogue import (  # noqa: F401
    evidence,
    exports,
    gates,
    intake,
    labels,
    ledger,
    metrics,
    reports,
    scalars,
    streams,
    themes,
    windows,
)
from voxboard.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
