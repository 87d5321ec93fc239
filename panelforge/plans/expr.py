"""Factor expressions: JSON trees validated, hashed and compiled to staged Columns.

A tree is a symbol ``{"symbol": name}`` (or a plain string), a constant
``{"const": number}`` (or a plain number), or a call ``{"call": name, "args": [...]}``.
``compiled`` adds one column for each factor to a panel. Every call node becomes
a column of its own, named by the hash of its tree: equal subtrees are worked out
once, and a window over a window is two stages. Catalyst joins stages that share a
partitioning into one sort, so the number of shuffles is the number of changes
between time-series and cross-sectional nodes along a path.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.factor import MACROS, OPS
from panelforge.functions.panel import KEYS, Keys

MAX_WINDOW, MAX_POWER = 300, 8


class ExpressionError(ValueError):
    """A tree that cannot be compiled."""


def _normal(node):
    """The tree in its plain form: strings, numbers and calls."""
    if isinstance(node, bool) or node is None:
        raise ExpressionError(f"not an expression: {node!r}")
    if isinstance(node, (int, float, str)):
        return node
    if isinstance(node, dict):
        if "symbol" in node:
            return str(node["symbol"])
        if "const" in node:
            return _normal(node["const"])
        if "call" in node:
            if node.get("kwargs"):
                raise ExpressionError("arguments are positional")
            return {"call": node["call"], "args": [_normal(a) for a in node.get("args", [])]}
    raise ExpressionError(f"not an expression: {node!r}")


def validated(node, symbols: set[str]) -> object:
    """The plain form of a tree that may be compiled, macros expanded; raises ExpressionError."""
    node = _normal(node)
    if isinstance(node, str):
        if node not in symbols:
            raise ExpressionError(f"unknown symbol {node}")
        return node
    if isinstance(node, (int, float)):
        return node
    name, args = node["call"], node["args"]
    if name in MACROS:
        least, most, rewrite = MACROS[name]
        if not least <= len(args) <= most:
            raise ExpressionError(f"{name} takes {least} to {most} arguments")
        return validated(rewrite(*args), symbols)
    if name not in OPS:
        raise ExpressionError(f"unknown operator {name}")
    op = OPS[name]
    if not op.least <= len(args) <= op.most:
        raise ExpressionError(f"{name} takes {op.least} to {op.most} arguments")
    out = []
    for i, a in enumerate(args):
        if i in op.numbers:
            if isinstance(a, dict) or (isinstance(a, str) and i in op.windows + op.lags):
                raise ExpressionError(f"argument {i + 1} of {name} is a constant")
            if i in op.windows and not (a == int(a) and 1 <= a <= MAX_WINDOW):
                raise ExpressionError(f"window {a} of {name} is not within 1 to {MAX_WINDOW}")
            if i in op.lags and not (a == int(a) and 0 <= a <= MAX_WINDOW):
                raise ExpressionError(f"lag {a} of {name} is not within 0 to {MAX_WINDOW}")
            out.append(int(a) if i in op.windows + op.lags else a)
        else:
            out.append(validated(a, symbols))
    if name == "pow" and isinstance(out[1], (int, float)) and abs(out[1]) > MAX_POWER:
        raise ExpressionError(f"powers go to {MAX_POWER}")
    return {"call": name, "args": out}


def tree_hash(node) -> str:
    """Equal for trees that are equal once macros such as adv are expanded."""

    def expand(n):
        n = _normal(n)
        if not isinstance(n, dict):
            return n
        if n["call"] in MACROS:
            return expand(MACROS[n["call"]][2](*n["args"]))
        return {"call": n["call"], "args": [expand(a) for a in n["args"]]}

    return hashlib.sha256(json.dumps(expand(node), sort_keys=True).encode()).hexdigest()


def unique_names(names: list[str]) -> list[str]:
    """Names fit for columns: letters, digits and underscores, lower case, repeats numbered."""
    out, seen = [], {}
    for n in names:
        n = re.sub(r"\W+", "_", n).strip("_").lower() or "factor"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}__v{seen[n]}")
    return out


def distinct_factors(factors: dict[str, object]) -> dict[str, object]:
    """The first of the factors with equal trees."""
    seen: set[str] = set()
    return {n: t for n, t in factors.items() if not ((h := tree_hash(t)) in seen or seen.add(h))}


def compiled(panel: DataFrame, factors: dict[str, object], keys: Keys = KEYS) -> DataFrame:
    """``panel`` with a column for each factor."""
    symbols = set(panel.columns) - {keys.entity, keys.time}
    trees = {name: validated(t, symbols) for name, t in factors.items()}
    made: dict[str, str] = {}
    df = panel

    def build(node) -> Column:
        nonlocal df
        if isinstance(node, str):
            return F.col(node)
        if isinstance(node, (int, float)):
            return F.lit(float(node))
        if (h := tree_hash(node)) not in made:
            op, column = OPS[node["call"]], f"__{h[:16]}"
            args = [a if i in op.numbers else build(a) for i, a in enumerate(node["args"])]
            if node["call"] == "ema":
                from panelforge.operators.kernels import ema

                df = ema(df.withColumn("__x", args[0]), "__x", column, args[1], keys).drop("__x")
            else:
                df = df.withColumn(column, op.build(*args, keys=keys) if op.keyed else op.build(*args))
            made[h] = column
        return F.col(made[h])

    results = {name: build(t) for name, t in trees.items()}
    return df.select(*panel.columns, *[c.alias(n) for n, c in results.items()])
