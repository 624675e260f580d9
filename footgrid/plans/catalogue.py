"""All registered queries."""

from __future__ import annotations

from types import ModuleType

from footgrid.plans import detections, graphs, learning, shapes, spatial

MODULES: tuple[ModuleType, ...] = (detections, spatial, graphs, learning, shapes)


def _own(module: ModuleType):
    return {k: v for k, v in vars(module).items() if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == module.__name__}


def queries():
    return {k: v for m in MODULES for k, v in _own(m).items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.SQL.items()}
