"""The registered queries of the style and typo operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

from weftline.plans.registry import ORACLES, QUERIES, Query

for _name in ("texts", "dictionary", "labels", "rules", "metrics", "streams", "corrector", "style", "trees"):
    importlib.import_module(f"weftline.plans.{_name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
