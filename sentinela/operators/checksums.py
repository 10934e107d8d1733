"""Check-digit validators as column expressions over any formatted number."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentinela.functions.text import once


def _of_digits(rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A rule over the digits of a formatted number, which are taken out once."""
    return lambda raw: once(F.regexp_replace(raw, "[^0-9]", ""), rule)


def _at(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).cast("int")


def _sum(d: Column, weights: Sequence[int], start: int = 0) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _at(d, start + i) * w
    return total


def _shape(d: Column, n: int) -> Column:
    """n digits that are not all equal."""
    return (F.length(d) == n) & (F.replace(d, F.substring(d, 1, 1), F.lit("")) != "")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@_of_digits
def valid_cpf(d: Column) -> Column:
    check = lambda n: (_sum(d, range(n + 1, 1, -1)) * 10) % 11 % 10  # noqa: E731  10 counts as 0
    return _sure(_shape(d, 11) & (check(9) == _at(d, 9)) & (check(10) == _at(d, 10)))


@_of_digits
def valid_cnpj(d: Column) -> Column:
    def check(weights: list[int]) -> Column:
        r = _sum(d, weights) % 11
        return F.when(r < 2, 0).otherwise(11 - r)

    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return _sure(_shape(d, 14) & (check(first) == _at(d, 12)) & (check([6, *first]) == _at(d, 13)))


@_of_digits
def valid_cnh(d: Column) -> Column:
    r1 = _sum(d, range(9, 0, -1)) % 11
    discount = F.when(r1 >= 10, 2).otherwise(0)
    r2 = _sum(d, range(1, 10)) % 11 - discount
    r2 = F.when(r2 < 0, r2 + 11).otherwise(r2)
    tens = lambda r: F.when(r >= 10, 0).otherwise(r)
    return _sure(_shape(d, 11) & (tens(r1) == _at(d, 9)) & (tens(r2) == _at(d, 10)))


@_of_digits
def valid_pis(d: Column) -> Column:
    v = 11 - _sum(d, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return _sure(_shape(d, 11) & (F.when(v >= 10, 0).otherwise(v) == _at(d, 10)))


@_of_digits
def valid_cns(d: Column) -> Column:
    return _sure((F.length(d) == 15) & (_at(d, 0) >= 1) & (_sum(d, range(15, 0, -1)) % 11 == 0))


@_of_digits
def valid_titulo(d: Column) -> Column:
    state = F.substring(d, 9, 2).cast("int")
    v1 = _sum(d, range(2, 10)) % 11 % 10
    v2 = _sum(d, range(7, 10), 8) % 11 % 10
    return _sure((F.length(d) == 12) & state.between(1, 28) & (v1 == _at(d, 10)) & (v2 == _at(d, 11)))


VALIDATORS = {"cpf": valid_cpf, "cnpj": valid_cnpj, "cnh": valid_cnh, "pis": valid_pis, "cns": valid_cns, "titulo": valid_titulo}
