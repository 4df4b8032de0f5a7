"""Check digits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _product(a: Column, b: Column) -> Column:
    """Product in the dihedral group of order ten: rotations 0-4, reflections 5-9."""
    turn = F.when(b < 5, (a + b) % 5).otherwise(5 + (a + b - 5) % 5)
    flip = F.when(b < 5, 5 + (a - 5 - b + 5) % 5).otherwise((a - b + 10) % 5)
    return F.when(a < 5, turn).otherwise(flip)


def _powers() -> Column:
    """The permutation of Verhoeff's scheme applied 0 to 7 times."""
    step, rows = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), [list(range(10))]
    for _ in range(7):
        rows.append([step[x] for x in rows[-1]])
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows])


def verhoeff(digits: Column) -> Column:
    """Whether a string of digits passes Verhoeff's check; false for null, empty or anything else."""
    reverse = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    turned = F.transform(reverse, lambda d, k: F.get(F.get(_powers(), k % 8), d))
    check = F.aggregate(turned, F.lit(0), lambda acc, x: _product(acc, x).cast("int"))
    return F.coalesce(F.when(digits.rlike("^[0-9]+$"), check == 0), F.lit(False))
