"""The special functions as DuckDB SQL: the independent side of the query tests."""

from __future__ import annotations


def ibeta(a: str, b: str, x: str) -> str:
    """I_x(a, b); the continued fraction is a fold over a list of levels."""

    def tail(p: str, q: str, z: str) -> str:
        levels = f"list_prepend(0.0::DOUBLE, list_reverse(range(1, 21 + ceil(5 * sqrt(greatest({p}, {q})))::BIGINT)::DOUBLE[]))"
        level = f"(CASE WHEN (k_::BIGINT) % 2 = 0 THEN (k_ / 2) * ({q} - k_ / 2) ELSE -({p} + (k_ - 1) / 2) * ({p} + {q} + (k_ - 1) / 2) END) * {z} / (({p} + k_ - 1) * ({p} + k_))"
        fold = f"list_reduce({levels}, lambda acc_, k_: ({level}) / (1 + acc_))"
        return f"(exp(lgamma({p} + {q}) - lgamma({p}) - lgamma({q}) + {p} * ln({z}) + {q} * ln(1 - {z})) / {p} / (1 + {fold}))"

    a, b, x = f"(({a})::DOUBLE)", f"(({b})::DOUBLE)", f"(({x})::DOUBLE)"
    return f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} <= ({a} + 1) / ({a} + {b} + 2) THEN {tail(a, b, x)} ELSE 1 - {tail(b, a, f'(1 - {x})')} END)"


def gamma_q(a: str, x: str) -> str:
    a, x = f"(({a})::DOUBLE)", f"(({x})::DOUBLE)"
    down = f"list_reverse(range(1, 61 + ceil(8 * sqrt({a}))::BIGINT)::DOUBLE[])"
    series = f"(1 - list_reduce(list_prepend(1.0::DOUBLE, {down}), lambda acc_, k_: 1 + {x} / ({a} + k_) * acc_) * exp({a} * ln({x}) - {x} - lgamma({a} + 1)))"
    fraction = f"(exp({a} * ln({x}) - {x} - lgamma({a})) / ({x} + 1 - {a} - list_reduce(list_prepend(0.0::DOUBLE, {down}), lambda acc_, k_: k_ * (k_ - {a}) / ({x} + 2 * k_ + 1 - {a} - acc_))))"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} <= {a} + 1 THEN {series} ELSE {fraction} END)"


def two_sided_t(t: str, v: str) -> str:
    return ibeta(f"({v}) / 2", "0.5", f"({v}) / (({v}) + ({t}) * ({t}))")


def t_quantile(z: str, v: str) -> str:
    """The t quantile at the normal quantile z, by Fisher's expansion: for degrees of freedom in the thousands and more."""
    return f"({z} + ({z} ** 3 + {z}) / (4 * ({v})) + (5 * {z} ** 5 + 16 * {z} ** 3 + 3 * {z}) / (96 * ({v}) ** 2) + (3 * {z} ** 7 + 19 * {z} ** 5 + 17 * {z} ** 3 - 15 * {z}) / (384 * ({v}) ** 3))"


def f_upper(f: str, d1: str, d2: str) -> str:
    return ibeta(f"({d2}) / 2", f"({d1}) / 2", f"({d2}) / (({d2}) + ({d1}) * ({f}))")


def uniform(*parts: str) -> str:
    key = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"((('0x' || substr(md5({key}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


def normal(*parts: str) -> str:
    return f"(sqrt(-2 * ln({uniform(*parts, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {uniform(*parts, chr(39) + 'b' + chr(39))}))"
