"""Linear equations over assets and groups, written as text, as rows of a matrix.

``2 * Equity - 0.5 * "AAPL" <= 0.3 * US + 0.1``: terms are numbers, names or products of numbers and one name; a name
is an asset or a label of any level of groups, and stands for the sum of its assets' weights.
"""

from __future__ import annotations

import re

import numpy as np


class EquationError(ValueError):
    """An equation that cannot be read."""


class GroupNotFoundError(EquationError):
    """A name that is neither an asset nor a group."""


_TOKEN = re.compile(r"\s*(?:(?P<compare><=|>=|==|=|<|>)|(?P<sign>[+\-*])|(?P<number>[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+)|\"(?P<quoted>[^\"]+)\"|(?P<name>[^\s+\-*<>=\"]+))")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        found = _TOKEN.match(text, at)
        if not found:
            raise EquationError(f"cannot read {text[at:]!r} in {text!r}")
        kind = found.lastgroup
        out.append(("name" if kind == "quoted" else kind, found[kind]))
        at = found.end()
    return out


def _side(parts: list[tuple[str, str]], text: str) -> tuple[dict[str, float], float]:
    """(coefficient of each name, constant) of one side."""
    names: dict[str, float] = {}
    constant, k = 0.0, 0
    if not parts:
        raise EquationError(f"a side of {text!r} is empty")
    while k < len(parts):
        sign = 1.0
        while k < len(parts) and parts[k][0] == "sign" and parts[k][1] in "+-":
            sign *= -1.0 if parts[k][1] == "-" else 1.0
            k += 1
        factor, name, expect = sign, None, True
        while k < len(parts):
            kind, value = parts[k]
            if expect and kind == "number":
                factor *= float(value)
            elif expect and kind == "name" and name is None:
                name = value
            elif not expect and (kind, value) == ("sign", "*"):
                expect, k = True, k + 1
                continue
            else:
                break
            expect, k = False, k + 1
        if expect or (k < len(parts) and parts[k][0] != "sign"):
            raise EquationError(f"a term is missing or doubled in {text!r}")
        if name is None:
            constant += factor
        else:
            names[name] = names.get(name, 0.0) + factor
    return names, constant


def rows(equations: list[str], assets: list[str], groups: dict[str, list[str]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A, b, C, d): A w <= b and C w = d say the same as the equations on weights of ``assets``.

    ``groups`` maps an asset to its labels, one per level. Strict comparisons have no closed set of solutions and are rejected.
    """
    members: dict[str, set[int]] = {}
    for i, asset in enumerate(assets):
        for name in {asset, *(groups or {}).get(asset, [])}:
            members.setdefault(name, set()).add(i)
    less, equal = [], []
    for text in equations:
        found = tokens(text)
        at = [k for k, (kind, _) in enumerate(found) if kind == "compare"]
        if len(at) != 1:
            raise EquationError(f"{text!r} needs one comparison")
        sign = found[at[0]][1]
        if sign in "<>":
            raise EquationError(f"strict comparison in {text!r}")
        (left, x), (right, y) = _side(found[: at[0]], text), _side(found[at[0] + 1 :], text)
        row = np.zeros(len(assets))
        for side, factor in ((left, 1.0), (right, -1.0)):
            for name, c in side.items():
                if name not in members:
                    raise GroupNotFoundError(f"{name!r} of {text!r} is no asset and no group")
                row[sorted(members[name])] += factor * c
        if sign == ">=":
            less.append((-row, x - y))
        else:
            (less if sign == "<=" else equal).append((row, y - x))
    stack = lambda z: (np.array([r for r, _ in z]).reshape(-1, len(assets)), np.array([v for _, v in z], dtype=float))
    return *stack(less), *stack(equal)
