"""Named components of a spec.  A component is registered under a kind and a name, and found by both."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from typing import Any

KINDS = ("source", "feature", "filter", "indicator", "label", "transform", "model", "loss", "splitter", "metric", "backtest")
_known: dict[str, dict[str, Any]] = {k: {} for k in KINDS}
_loaded = False


def register(kind: str, name: str) -> Callable:
    if kind not in _known:
        raise ValueError(f"no component kind {kind!r}; there are {', '.join(KINDS)}")

    def add(thing: Any) -> Any:
        old = _known[kind].get(name)
        if old is not None and (old.__module__, old.__qualname__) != (thing.__module__, thing.__qualname__):
            raise ValueError(f"{kind} {name!r} is registered twice: {old.__module__} and {thing.__module__}")
        _known[kind][name] = thing
        return thing

    return add


def load_all() -> None:
    """Import every module that may register components."""
    global _loaded
    if _loaded:
        return
    for package in ("rankloom.sources", "rankloom.operators", "rankloom.plans"):
        root = importlib.import_module(package)
        for m in pkgutil.iter_modules(root.__path__, package + "."):
            importlib.import_module(m.name)
    _loaded = True


def names(kind: str) -> list[str]:
    load_all()
    return sorted(_known[kind])


def get(kind: str, name: str) -> Any:
    load_all()
    if name not in _known[kind]:
        raise KeyError(f"no {kind} {name!r}; known: {', '.join(sorted(_known[kind])) or 'none'}")
    return _known[kind][name]


def build(component: dict, kind: str, **extra: Any) -> Any:
    return get(kind, component["func"])(**{**component.get("kwargs", {}), **extra})
