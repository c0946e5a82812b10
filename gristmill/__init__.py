"""Audit of overridden type checks, and corpus preparation, on PySpark.

    import gristmill
    found, failed = gristmill.analyze(sources)      # sources(path, text) or files(path, content)
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Functions of this package travel to the executors by value, so a cluster needs no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def analyze(sources: DataFrame, select: set[str] | None = None, ignore: set[str] | frozenset[str] = frozenset(), max_file_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings, and errors (path, kind, message), of sources. Each file is parsed once."""
    from .operators import local
    from .store import settled

    made = settled(local.audited(sources, select, ignore, max_file_bytes))
    return local.found(made), local.failed(made)
