"""Normal-distribution functions as SQL expression text.

Neither Spark SQL nor DuckDB ships an inverse normal CDF or ``erf``.  Both
functions are therefore emitted as plain arithmetic SQL text so that the very
same formula runs inside Spark's whole-stage codegen (via ``F.expr``) and in the
DuckDB oracle.  Only ``sqrt``, ``ln``, ``exp``, ``abs`` and ``CASE`` are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Wichura (1988), Algorithm AS 241 (PPND16), published
# coefficients, highest power first.  Central region |p - 0.5| <= 0.425.
AS241_CENTRAL_NUM = [2509.0809287301226727, 33430.575583588128105,
                     67265.770927008700853, 45921.953931549871457,
                     13731.693765509461125, 1971.5909503065514427,
                     133.14166789178437745, 3.387132872796366608]
AS241_CENTRAL_DEN = [5226.495278852545561, 28729.085735721942674,
                     39307.89580009271061, 21213.794301586595867,
                     5394.1960214247511077, 687.1870074920579083,
                     42.313330701600911252, 1.0]
# Intermediate region, r = sqrt(-ln(min(p, 1-p))) <= 5, evaluated at r - 1.6.
AS241_MID_NUM = [7.7454501427834140764e-4, 0.0227238449892691845833,
                 0.24178072517745061177, 1.27045825245236838258,
                 3.64784832476320460504, 5.7694972214606914055,
                 4.6303378461565452959, 1.42343711074968357734]
AS241_MID_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4,
                 0.0151986665636164571966, 0.14810397642748007459,
                 0.68976733498510000455, 1.6763848301838038494,
                 2.05319162663775882187, 1.0]
# Tail region r > 5, evaluated at r - 5.
AS241_TAIL_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5,
                  0.0012426609473880784386, 0.026532189526576123093,
                  0.29656057182850489123, 1.7848265399172913358,
                  5.4637849111641143699, 6.6579046435011037772]
AS241_TAIL_DEN = [2.04426310338993978564e-15, 1.4215117583164458887e-7,
                  1.8463183175100546818e-5, 7.868691311456132591e-4,
                  0.0148753612908506148525, 0.13692988092273580531,
                  0.59983220655588793769, 1.0]

# Hart (1968) double-precision normal tail, as published by
# G. West (2005), "Better approximations to cumulative normal functions".
HART_NUM = [0.0352624965998911, 0.700383064443688, 6.37396220353165,
            33.912866078383, 112.079291497871, 221.213596169931,
            220.206867912376]
HART_DEN = [0.0883883476483184, 1.75566716318264, 16.064177579207,
            86.7807322029461, 296.564248779674, 637.333633378831,
            793.826512519948, 440.413735824752]
SQRT_2PI = 2.506628274631
# ---------------------------------------------------------------------------


def _num(v: float) -> str:
    # Scientific notation is a DOUBLE literal in both Spark SQL and DuckDB
    # (plain decimals would be DECIMAL and overflow their scale).
    return format(float(v), ".17e")


def _horner(coefs: list[float], x: str) -> str:
    expr = _num(coefs[0])
    for c in coefs[1:]:
        expr = f"({expr} * {x} + {_num(c)})"
    return expr


def ppf_sql(p: str) -> str:
    """SQL text for the standard normal quantile of the SQL expression ``p``.

    NULL outside (0, 1).
    """
    q = f"(({p}) - 5e-1)"
    rc = f"(1.80625e-1 - {q} * {q})"
    central = (f"({q} * {_horner(AS241_CENTRAL_NUM, rc)} / "
               f"{_horner(AS241_CENTRAL_DEN, rc)})")
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1e0 - ({p}) END))"
    rm = f"({r} - 1.6e0)"
    rt = f"({r} - 5e0)"
    mid = f"({_horner(AS241_MID_NUM, rm)} / {_horner(AS241_MID_DEN, rm)})"
    tail = f"({_horner(AS241_TAIL_NUM, rt)} / {_horner(AS241_TAIL_DEN, rt)})"
    outer = (f"(CASE WHEN {q} < 0 THEN -1e0 ELSE 1e0 END * "
             f"CASE WHEN {r} <= 5e0 THEN {mid} ELSE {tail} END)")
    return (f"(CASE WHEN ({p}) IS NULL OR ({p}) <= 0 OR ({p}) >= 1 THEN NULL "
            f"WHEN abs({q}) <= 4.25e-1 THEN {central} ELSE {outer} END)")


def lower_tail_sql(z: str) -> str:
    """SQL text for Phi(-|z|), the one-sided tail mass beyond |z|."""
    x = f"abs({z})"
    e = f"exp(-({x}) * ({x}) / 2e0)"
    near = f"({e} * {_horner(HART_NUM, x)} / {_horner(HART_DEN, x)})"
    cf = f"({x} + 6.5e-1)"
    for k in (4, 3, 2, 1):
        cf = f"({x} + {k}e0 / {cf})"
    far = f"({e} / {cf} / {_num(SQRT_2PI)})"
    return (f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN {x} > 37 THEN 0e0 "
            f"WHEN {x} < 7.07106781186547e0 THEN {near} ELSE {far} END)")


def cdf_sql(z: str) -> str:
    """SQL text for the standard normal CDF Phi(z)."""
    t = lower_tail_sql(z)
    return f"(CASE WHEN ({z}) > 0 THEN 1e0 - {t} ELSE {t} END)"


def pdf_sql(x: str, mean: str = "0e0", std: str = "1e0") -> str:
    """SQL text for the normal density; NULL when std is 0 or NULL."""
    return (f"(CASE WHEN ({std}) IS NULL OR ({std}) = 0 THEN NULL ELSE "
            f"exp(-5e-1 * (({x}) - ({mean})) * (({x}) - ({mean})) / (({std}) * ({std}))) "
            f"/ (({std}) * {_num(math.sqrt(2 * math.pi))}) END)")
