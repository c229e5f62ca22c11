"""Tail probabilities as SQL, for queries whose result holds them.

Written apart from ``functions.tails``: the gamma function is the engine's own,
the fraction of the incomplete beta function is folded over a list.
"""

from __future__ import annotations


def _fold(steps: str, start: str, step: str) -> str:
    """``step`` over (acc, k) for k = steps, ..., 1."""
    return f"list_reduce(list_reverse(range(1, {steps} + 1))::DOUBLE[], lambda acc, k: {step}, ({start})::DOUBLE)"


def normal_p(z: str) -> str:
    """Two-sided normal p of a column."""
    x = f"(abs({z}) / sqrt(2e0))"
    near = f"1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {x} * " + _fold("80", "1", f"1 + 2 * {x} * {x} / (2 * k + 1) * acc")
    far = f"exp(-{x} * {x}) / sqrt(pi()) / " + _fold("120", x, f"{x} + k / 2 / acc")
    return f"CASE WHEN {x} < 2 THEN {near} ELSE {far} END"


def _fraction(a: str, b: str, x: str) -> str:
    m = "floor(k / 2)"
    odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
    even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
    return _fold(f"(300 + 8 * sqrt({a} + {b}))::INT", "1", f"1 + CASE WHEN k % 2 = 1 THEN {odd} ELSE {even} END / acc")


def beta(a: str, b: str, x: str, rest: str) -> str:
    """Regularised incomplete beta function of columns; ``rest`` is 1 - x."""
    front = f"exp({a} * ln({x}) + {b} * ln({rest}) - (lgamma({a}) + lgamma({b}) - lgamma({a} + {b})))"
    low, high = f"{front} / {a} / {_fraction(a, b, x)}", f"1 - {front} / {b} / {_fraction(b, a, rest)}"
    return f"CASE WHEN {x} <= 0 THEN 0e0 WHEN {rest} <= 0 THEN 1e0 WHEN {x} <= ({a} + 1) / ({a} + {b} + 2) THEN {low} ELSE {high} END"


def t_p(t: str, df: str) -> str:
    """Two-sided Student p of columns."""
    return beta(f"({df} / 2e0)", "0.5e0", f"({df} / ({df} + {t} * {t}))", f"({t} * {t} / ({df} + {t} * {t}))")


def f_p(f: str, df1: str, df2: str) -> str:
    """Upper tail of the F distribution."""
    whole = f"({df2} + {df1} * {f})"
    return beta(f"({df2} / 2e0)", f"({df1} / 2e0)", f"({df2} / {whole})", f"({df1} * {f} / {whole})")


def chi2_p(x: str, df: str) -> str:
    """Upper tail of the chi-square distribution."""
    a, h = f"({df} / 2e0)", f"({x} / 2e0)"
    front = f"exp({a} * ln({h}) - {h} - lgamma({a}))"
    series = f"1 - {front} / {a} * " + _fold("200", "1", f"1 + {h} / ({a} + k) * acc")
    fraction = f"{front} / " + _fold("300", f"{h} + 601 - {a}", f"{h} + 2 * k - 1 - {a} - k * (k - {a}) / acc")
    return f"CASE WHEN {h} <= 0 THEN 1e0 WHEN {h} < {a} + 1 THEN {series} ELSE {fraction} END"


def stars(p: str) -> str:
    return (
        f"CASE WHEN {p} <= 0.001e0 THEN '***' WHEN {p} <= 0.01e0 THEN '**' WHEN {p} <= 0.05e0 THEN '*' WHEN {p} <= 0.1e0 THEN '.' ELSE '' END"
    )
