"""All registered queries of the sensing operators."""

from __future__ import annotations

import importlib
import importlib.util

from .registry import ORACLES, QUERIES, Query

for _name in ("relational", "signal", "learning", "io", "streams"):
    if importlib.util.find_spec(f"{__package__}.{_name}"):
        importlib.import_module(f"{__package__}.{_name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
