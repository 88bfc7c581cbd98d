"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ["q_urls", "q_metrics", "q_corpus", "q_joins", "q_drift", "q_splits", "q_ranking", "q_inference", "q_models", "q_synthesis"]


def _load():
    from . import registry

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracles():
    return dict(_load().ORACLES)
