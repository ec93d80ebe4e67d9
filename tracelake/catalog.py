"""All registered queries of the core library, by operator id, with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake import registry

FLAGSHIP = "r09_hybrid_search"


def _load() -> None:
    for module in pkgutil.iter_modules(registry.__path__):
        importlib.import_module(f"{registry.__name__}.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
