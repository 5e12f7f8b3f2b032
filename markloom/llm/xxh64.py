"""XXH64 of strings in DuckDB SQL, for the oracle of SimHash. Numbers are UHUGEINT, taken modulo 2^64."""

from __future__ import annotations

#: The hash's primes.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WORD = 1 << 64


def number(n: int) -> str:
    return f"CAST({n} AS UHUGEINT)"


def times(a: str, n: int) -> str:
    return f"(({a}) * {number(n)} % {number(WORD)})"


def plus(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % {number(WORD)})"


def rotated(a: str, by: int) -> str:
    return f"(({a}) * {number(1 << by)} % {number(WORD)} + ({a}) // {number(1 << 64 - by)})"


def xor(a: str, b: str) -> str:
    return f"CAST(xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT)) AS UHUGEINT)"


def little_endian(at: str, size: int) -> str:
    """The number in `size` bytes from byte `at` of the hexadecimal column x."""
    digits = " || ".join(f"substr(x, CAST(2 * ({at}) + {2 * k + 1} AS BIGINT), 2)" for k in reversed(range(size)))
    return f"CAST(CAST('0x' || {digits} AS UBIGINT) AS UHUGEINT)"


def mixed(state: str, lane: str) -> str:
    return times(rotated(plus(state, times(lane, P2)), 31), P1)


def folded(start: str, first: str, end: str, lane: str, step: str) -> str:
    """`step` over a and q, from `start`, for the lanes number `first` to `end` (i)."""
    return f"list_reduce(list_concat([{start}], list_transform(range({first}, {end}), lambda i: {lane})), lambda a, q: {step})"


def ctes(source: str, seed: int) -> str:
    """CTEs from `source` (g: distinct strings) to xxh64 (g, h UBIGINT)."""
    starts = [(seed + P1 + P2) % WORD, (seed + P2) % WORD, seed, (seed - P1) % WORD]
    lanes = ", ".join(folded(number(s), "0", "n // 32", little_endian(f"32 * i + {8 * k}", 8), mixed("a", "q")) + f" AS v{k}" for k, s in enumerate(starts))
    joined = plus(rotated("v0", 1), rotated("v1", 7), rotated("v2", 12), rotated("v3", 18))
    merge = [f"x{k + 1} AS (SELECT * REPLACE ({plus(times(xor('h', mixed(number(0), f'v{k}')), P1), number(P4))} AS h) FROM x{k})" for k in range(4)]
    eights = folded("h", "4 * (n // 32)", "n // 8", little_endian("8 * i", 8), plus(times(rotated(xor("a", mixed(number(0), "q")), 27), P1), number(P4)))
    four = xor("h", times(little_endian("8 * (n // 8)", 4), P1))
    ones = folded("h", "4 * (n // 4)", "n", little_endian("i", 1), times(rotated(xor("a", times("q", P5)), 11), P1))
    steps = [
        f"x_bytes AS (SELECT g, hex(encode(g)) AS x, CAST(octet_length(encode(g)) AS BIGINT) AS n FROM {source})",
        f"x_lanes AS (SELECT g, x, n, {lanes} FROM x_bytes)",
        f"x0 AS (SELECT *, {joined} AS h FROM x_lanes)",
        *merge,
        f"x5 AS (SELECT g, x, n, {plus(f'CASE WHEN n >= 32 THEN h ELSE {number((seed + P5) % WORD)} END', 'CAST(n AS UHUGEINT)')} AS h FROM x4)",
        f"x6 AS (SELECT g, x, n, {eights} AS h FROM x5)",
        f"x7 AS (SELECT g, x, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM x6)",
        f"x8 AS (SELECT g, x, n, CASE WHEN n % 8 >= 4 THEN {plus(times(rotated('h', 23), P2), number(P3))} ELSE h END AS h FROM x7)",
        f"x9 AS (SELECT g, {ones} AS h FROM x8)",
        f"x10 AS (SELECT g, {times(xor('h', f'h // {number(1 << 33)}'), P2)} AS h FROM x9)",
        f"x11 AS (SELECT g, {times(xor('h', f'h // {number(1 << 29)}'), P3)} AS h FROM x10)",
        f"xxh64 AS (SELECT g, CAST({xor('h', f'h // {number(1 << 32)}')} AS UBIGINT) AS h FROM x11)",
    ]
    return ",\n        ".join(steps)
