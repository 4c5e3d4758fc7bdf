"""What a table version depends on: its part of the spec, the source's files and the code of its components."""

from __future__ import annotations

import ast
import inspect
import sys
from typing import Any

from rankloom import registry
from rankloom.plans.spec import Spec, components, digest
from rankloom.sources.files import Files

BUILD = 1  # raise when the framework's own code changes what tables hold
PARTS = {"features": ["feature_spec*"], "universe": ["filter_spec"], "market": ["indicator_spec*"], "labels": ["label_spec"]}
KIND = {"feature_spec*": "feature", "filter_spec": "filter", "indicator_spec*": "indicator", "label_spec": "label"}


class _NoDocs(ast.NodeTransformer):
    def generic_visit(self, node: ast.AST) -> ast.AST:
        super().generic_visit(node)
        body = getattr(node, "body", None)
        if isinstance(body, list) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            node.body = body[1:] or [ast.Pass()]
        return node


def _registers(node: ast.AST) -> bool:
    calls = [d.func if isinstance(d, ast.Call) else d for d in getattr(node, "decorator_list", [])]
    return any(getattr(c, "id", getattr(c, "attr", None)) == "register" for c in calls)


def relevant(source: str, name: str) -> str:
    """A module's code without comments, docstrings and the components other than ``name``; helpers stay."""
    tree = ast.parse(source)
    tree.body = [n for n in tree.body if not _registers(n) or n.name == name]
    return ast.unparse(_NoDocs().visit(tree))


def code_of(thing: Any) -> str:
    try:
        return digest(relevant(inspect.getsource(sys.modules[thing.__module__]), thing.__name__))
    except (OSError, TypeError, KeyError):
        return digest(f"{thing.__module__}.{thing.__qualname__}")


def table_parts(spec: Spec, files: Files) -> dict[str, dict[str, Any]]:
    source = spec["data_spec"]["source"]
    common = {
        "build": BUILD, "source": source, "source_code": code_of(registry.get("source", source["func"])), "period": spec["data_spec"]["period"], "warmup_days": spec["data_spec"]["warmup_days"],
        "warehouse": files.stamp(spec["paths"]["warehouse"]),
    }
    out = {}
    for table, places in PARTS.items():
        used = [(KIND[p], c) for p in places for c in components(spec, p)]
        out[table] = {**common, "components": [c for _, c in used], "code": [code_of(registry.get(k, c["func"])) for k, c in used]}
    return out


def table_hashes(spec: Spec, files: Files) -> dict[str, str]:
    return {t: digest(p) for t, p in table_parts(spec, files).items()}


def plan_hashes(spec: Spec, files: Files) -> dict[str, str]:
    """By what the tables are built, whatever the source's files hold."""
    return {t: digest([(k, v) for k, v in sorted(p.items()) if k != "warehouse"]) for t, p in table_parts(spec, files).items()}
