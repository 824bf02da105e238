"""Punycode (RFC 3492) as a native column expression.

An internationalised host label is stored as ``xn--`` and ASCII characters.  The
decoder is a fold over those behind the last hyphen: each is a digit of base 36,
and a run of digits that ends under the threshold is one number, which says where
the next code point goes and what it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the parameters of RFC 3492, section 5 -----------------------
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE_POINT = 36, 1, 26, 38, 700, 72, 128
# --- end of fixed values -------------------------------------------------------
_LARGEST = (1 << 31) - 1
_STATE = "struct<points:array<bigint>,n:bigint,i:bigint,before:bigint,weight:bigint,k:bigint,bias:bigint,bad:boolean>"


def _let(name: str, value: str, use: str) -> str:
    return f"transform(array({value}), {name} -> {use})[0]"


def _adapted(delta: str, count: str, first: str) -> str:
    """The next bias.  A 31-bit delta is under the limit after at most six divisions."""
    limit = (BASE - T_MIN) * T_MAX // 2
    start = _let("d0", f"if({first}, {delta} div {DAMP}, {delta} div 2)", f"named_struct('d', d0 + d0 div {count}, 'k', 0L)")
    smaller = (f"aggregate(sequence(1, 6), {start}, (z, j) -> if(z.d > {limit}, "
               f"named_struct('d', z.d div {BASE - T_MIN}, 'k', z.k + {BASE}), z))")
    return _let("z", smaller, f"z.k + {BASE - T_MIN + 1} * z.d div (z.d + {SKEW})")


def _step() -> str:
    digit = "CASE WHEN c RLIKE '^[a-z]$' THEN ascii(c) - 97 WHEN c RLIKE '^[0-9]$' THEN ascii(c) - 22 ELSE -1 END"
    same = "'before', s.before"
    threshold = f"least(greatest(s.k - s.bias, {T_MIN}L), {T_MAX}L)"
    bad = "named_struct('points', s.points, 'n', s.n, 'i', s.i, 'before', s.before, 'weight', s.weight, 'k', s.k, 'bias', s.bias, 'bad', true)"
    more = (f"named_struct('points', s.points, 'n', s.n, 'i', i, {same}, 'weight', s.weight * ({BASE} - t), 'k', s.k + {BASE}, "
            "'bias', s.bias, 'bad', false)")
    count = "(size(s.points) + 1)"
    placed = f"array_insert(s.points, CAST(i % {count} + 1 AS INT), s.n + i div {count})"
    done = (f"named_struct('points', {placed}, 'n', s.n + i div {count}, 'i', i % {count} + 1, 'before', i % {count} + 1, 'weight', 1L, "
            f"'k', {BASE}L, 'bias', {_adapted('(i - s.before)', count, 's.before = 0')}, 'bad', false)")
    use = f"CASE WHEN d < 0 OR i > {_LARGEST} OR s.weight > {_LARGEST} THEN {bad} WHEN d < t THEN {done} ELSE {more} END"
    return (f"if(s.bad, s, CAST({_let('d', digit, _let('t', threshold, _let('i', 's.i + d * s.weight', use)))} AS {_STATE}))")


def decoded_labels(labels: str) -> Column:
    """The column ``labels``, an array of lower-case host labels, with those that
    begin with ``xn--`` decoded; one that is no Punycode stays as it is."""
    chars = "filter(split({}, ''), c -> c <> '')"
    rest = "substring(l, 5)"
    start = (f"CAST(named_struct('points', transform({chars.format(f'regexp_extract({rest}, ' + chr(39) + '^(.*)-' + chr(39) + ', 1)')}, "
             f"c -> CAST(ascii(c) AS BIGINT)), 'n', {FIRST_CODE_POINT}, 'i', 0, 'before', 0, 'weight', 1, 'k', {BASE}, "
             f"'bias', {FIRST_BIAS}, 'bad', false) AS {_STATE})")
    digits = chars.format(f"regexp_extract({rest}, '([^-]*)$', 1)")
    # an unfinished number leaves a weight behind
    wrong = f"size(e.points) = 0 OR e.bad OR e.weight <> 1 OR e.k <> {BASE} OR exists(e.points, p -> p > 1114111 OR p BETWEEN 55296 AND 57343)"
    text = "array_join(transform(e.points, p -> decode(unhex(lpad(hex(p), 8, '0')), 'UTF-32')), '')"
    decoded = _let("e", f"aggregate({digits}, {start}, (s, c) -> {_step()})", f"if({wrong}, l, {text})")
    return F.expr(f"transform({labels}, l -> if(startswith(l, 'xn--'), {decoded}, l))")
