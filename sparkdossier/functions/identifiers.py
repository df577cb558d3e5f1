"""Checksums of identifiers over strings of digits: native expressions for columns, and the same for the hits of a scan."""

from __future__ import annotations

import datetime
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the control digits, from the left.
PERSON_FIRST = (3, 7, 6, 1, 8, 9, 4, 5, 2)
PERSON_SECOND = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
ACCOUNT = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
COMPANY = (3, 2, 7, 6, 5, 4, 3, 2)


def digit(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1).try_cast("int")


def mod11(c: Column, weights: Sequence[int]) -> Column:
    """Control digit of the first ``len(weights)`` digits: 0 to 9, or 10 where there is none."""
    total = sum((digit(c, i) * w for i, w in enumerate(weights)), F.lit(0))
    return F.pmod(11 - total % 11, F.lit(11))


def digits_only(c: Column, least: int, most: int | None = None) -> Column:
    return F.coalesce(c.rlike(f"^[0-9]{{{least},{most or least}}}$"), F.lit(False))


def checked(c: Column, weights: Sequence[int]) -> Column:
    return mod11(c, weights) == digit(c, len(weights))


def valid_account(c: Column) -> Column:
    return digits_only(c, 11) & F.coalesce(checked(c, ACCOUNT), F.lit(False))


def valid_company(c: Column) -> Column:
    return digits_only(c, 9) & F.coalesce(checked(c, COMPANY), F.lit(False))


def valid_payment_reference(c: Column) -> Column:
    """3 to 25 digits whose last is right by Luhn, or by mod 11 with weights 2 to 7 from the right."""
    total = F.aggregate(
        F.transform(F.slice(F.split(F.reverse(c), ""), 2, 24), lambda x, i: F.coalesce(x.try_cast("int"), F.lit(0)) * (i % 6 + 2)), F.lit(0), lambda a, x: (a + x).cast("int")
    )
    by11 = F.pmod(11 - total % 11, F.lit(11)) == F.right(c, F.lit(1)).try_cast("int")
    return digits_only(c, 3, 25) & F.coalesce(F.call_function("luhn_check", c) | by11, F.lit(False))


def birth_date(c: Column) -> Column:
    """Birth date in a person's number, or null. Days over 40, and months over 40 or 80, are taken back first."""
    day, month, year, serial = (F.substring(c, a, n).try_cast("int") for a, n in ((1, 2), (3, 2), (5, 2), (7, 3)))
    day = F.when(day > 40, day - 40).otherwise(day)
    month = F.when(month > 80, month - 80).when(month > 40, month - 40).otherwise(month)
    century = F.when((serial >= 500) & (year <= 39), 2000).when(serial >= 900, 1900).when((serial >= 500) & (year >= 54), 1800).otherwise(1900)
    iso = F.format_string("%04d-%02d-%02d", century + year, month, day)
    return F.when(digits_only(c, 11) & (day >= 1) & (month >= 1) & (month <= 12), F.try_to_date(iso, "yyyy-MM-dd"))


def valid_person(c: Column) -> Column:
    return birth_date(c).isNotNull() & F.coalesce(checked(c, PERSON_FIRST) & checked(c, PERSON_SECOND), F.lit(False))


# The same checks of one number, for scanners: in a lambda over an array of hits the expressions above are interpreted node by node.
_ASCII_DIGITS = re.compile("[0-9]+")


def passes_mod11(number: str, weights: Sequence[int]) -> bool:
    """For ASCII digits only, which the callers have made sure of."""
    total = sum(map(operator.mul, number.encode(), weights)) - 48 * sum(weights)
    return (11 - total % 11) % 11 == int(number[len(weights)])


def is_account(number: str) -> bool:
    return len(number) == 11 and _ASCII_DIGITS.fullmatch(number) is not None and passes_mod11(number, ACCOUNT)


def is_company(number: str) -> bool:
    return len(number) == 9 and _ASCII_DIGITS.fullmatch(number) is not None and passes_mod11(number, COMPANY)


def is_person(number: str) -> bool:
    if len(number) != 11 or _ASCII_DIGITS.fullmatch(number) is None or not passes_mod11(number, PERSON_FIRST) or not passes_mod11(number, PERSON_SECOND):
        return False
    day, month, year, serial = int(number[:2]), int(number[2:4]), int(number[4:6]), int(number[6:9])
    day, month = day - 40 if day > 40 else day, month - 80 if month > 80 else month - 40 if month > 40 else month
    century = 2000 if serial >= 500 and year <= 39 else 1900 if serial >= 900 else 1800 if serial >= 500 and year >= 54 else 1900
    try:
        datetime.date(century + year, month, day)
    except ValueError:
        return False
    return True


def is_payment_reference(number: str) -> bool:
    if not 3 <= len(number) <= 25 or _ASCII_DIGITS.fullmatch(number) is None:
        return False
    digits = [int(d) for d in reversed(number)]
    luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))
    return luhn % 10 == 0 or (11 - sum(d * (i % 6 + 2) for i, d in enumerate(digits[1:])) % 11) % 11 == digits[0]
