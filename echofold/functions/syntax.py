"""Shape of source text: what its syntax tree looks like when names and values are left out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def shape(text: str | None) -> str | None:
    """Node kinds of a Python text, breadth first; null where it does not parse. Names, arguments,
    attributes and constants are kinds only; arithmetic and comparisons keep their operators."""
    import ast
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    if not tree.body:
        return None
    out = []
    for node in ast.walk(tree):
        kind = type(node).__name__
        if isinstance(node, ast.expr_context):
            continue
        if isinstance(node, ast.BinOp):
            kind += "." + type(node.op).__name__
        elif isinstance(node, ast.Compare):
            kind += "." + ".".join(type(o).__name__ for o in node.ops)
        out.append(kind.removeprefix("Async") if kind == "AsyncFunctionDef" else kind)
    return " ".join(out)


def syntax_shape():
    """Arrow UDF: text -> shape."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([shape(t) for t in text], dtype="object")

    return run
