"""JSON texts as trees: one canonical text for equal content, and the paths at which two trees differ."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The member that cannot be equal between two runs, and what stands for an absent side or the whole.
VOLATILE = ("tid_sekunder",)
PRESENT, ABSENT, WHOLE = "finnes", "MANGLER", "(rot)"
DIFFERENCES = "array<struct<sti:string,venstre:string,hoyre:string>>"


def _tree(text: str | None, volatile: Sequence[str]) -> tuple[Any] | None:
    """The tree of a text without its volatile members, in a tuple (a tree may be None); None where it cannot be read."""
    if text is None:
        return None
    try:
        return (json.loads(text, object_pairs_hook=lambda pairs: {k: v for k, v in pairs if k not in volatile}),)
    except (ValueError, RecursionError):
        return None


def _text(node: Any) -> str:
    """Compact text with sorted names. A lone half of a surrogate pair, which no UTF-8 holds, becomes a question mark."""
    out = json.dumps(node, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return out.encode("utf-8", "replace").decode("utf-8")


def _rewritten(text: str | None, volatile: Sequence[str]) -> str | None:
    tree = _tree(text, volatile)
    try:
        return None if tree is None else _text(tree[0])
    except RecursionError:
        return None


def _shown(node: Any) -> str:
    return "objekt" if isinstance(node, dict) else "liste" if isinstance(node, list) else _text(node)


def _differing(a: tuple[Any] | None, b: tuple[Any] | None) -> list[tuple[str, str, str]]:
    """The topmost paths at which two trees differ; below such a path nothing more is said."""
    if a is None or b is None:
        return [] if a is b else [(WHOLE, PRESENT if a else ABSENT, PRESENT if b else ABSENT)]
    out, todo = [], [("", a[0], b[0])]
    while todo:
        path, x, y = todo.pop()
        if isinstance(x, dict) and isinstance(y, dict):
            for k in sorted(x.keys() | y.keys(), reverse=True):
                if k in x and k in y:
                    todo.append((f"{path}.{k}", x[k], y[k]))
                else:
                    out.append((f"{path}.{k}", PRESENT if k in x else ABSENT, PRESENT if k in y else ABSENT))
        elif isinstance(x, list) and isinstance(y, list):
            if len(x) == len(y):
                todo.extend((f"{path}[{i}]", *xy) for i, xy in reversed(list(enumerate(zip(x, y, strict=True)))))
            else:
                out.append((f"{path}[]", f"{len(x)} elementer", f"{len(y)} elementer"))
        elif (isinstance(x, bool) != isinstance(y, bool) or x != y) and _shown(x) != _shown(y):  # NaN equals itself here
            out.append((path or WHOLE, _shown(x), _shown(y)))
    return sorted(out)


def canonical(text: Column, volatile: Sequence[str] = VOLATILE) -> Column:
    """The same text for equal content, whatever the order of names; volatile members are left out at any depth.

    Null for null, for what is no JSON, and for nesting too deep to read.
    """

    @F.pandas_udf("string")
    def rewrite(s: pd.Series) -> pd.Series:
        return pd.Series([_rewritten(t, volatile) for t in s], dtype="object")

    return rewrite(text)


def differences(a: Column, b: Column, volatile: Sequence[str] = VOLATILE) -> Column:
    """Array of ``sti, venstre, hoyre`` for two JSON texts, sorted by path; empty for equal content.

    A path is ``.name`` for a member and ``[i]`` for an element. Lists of unequal length differ as wholes (``[]``), a member
    of one side only is ``finnes`` or ``MANGLER``. Numbers are equal by value (1 and 1.0), true is no number. A text that is
    null or cannot be read is absent.
    """

    @F.pandas_udf(DIFFERENCES)
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        rows = (_differing(_tree(s, volatile), _tree(t, volatile)) for s, t in zip(x, y, strict=True))
        return pd.Series([[dict(zip(("sti", "venstre", "hoyre"), r, strict=True)) for r in d] for d in rows], dtype="object")

    return compare(a, b)
