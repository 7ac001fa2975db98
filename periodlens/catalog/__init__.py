"""Named queries over the benchmark tables, each with its SQL twin where SQL can say it."""

from periodlens.catalog.registry import ORACLES, QUERIES
from periodlens.catalog import (  # noqa: F401  (registration)
    counts,
    detection,
    evaluation,
    features,
    learning,
    sources,
    streams,
    texts,
)

__all__ = ["ORACLES", "QUERIES"]
