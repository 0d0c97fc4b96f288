"""Partial masks: as plain functions for the span kernel, and keep_first also as a column expression for whole columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hide(value: str, counted: Callable[[str], bool], hidden: Callable[[int], slice]) -> str:
    """'*' for the counted characters that `hidden` gives, from their number."""
    if counted(value):
        a, b, _ = hidden(len(value)).indices(len(value))
        return value[:a] + "*" * (b - a) + value[b:]
    out = list(value)
    places = [k for k, c in enumerate(out) if counted(c)]
    for k in places[hidden(len(places))]:
        out[k] = "*"
    return "".join(out)


def keep_first(v: str) -> str:
    return v[:1] + "○" * (len(v) - 1)


def keep_ends(v: str, head: int = 2, tail: int = 2) -> str:
    return _hide(v, str.isalnum, lambda n: slice(0, n) if n <= head + tail else slice(head, n - tail))


def mobile(v: str) -> str:
    if len(v) == 10 and v.isdecimal():
        return f"{v[:3]}****{v[7:]}"
    return _hide(v, str.isdecimal, lambda n: slice(3, 7)) if sum(map(str.isdecimal, v)) == 10 else keep_ends(v)


def landline(v: str) -> str:
    return _hide(v, str.isdecimal, lambda n: slice(2, max(2, n - 2)))


def email(v: str) -> str:
    local, at, domain = v.partition("@")
    return f"{local[:1]}***@{domain}" if at else "***"


def birthday(v: str) -> str:
    return _hide(v, str.isdecimal, lambda n: slice(max(0, n - 4), n))


def keep_last_four(v: str) -> str:
    return _hide(v, str.isdecimal, lambda n: slice(0, max(0, n - 4)))


def digits(v: str) -> str:
    return _hide(v, str.isdecimal, lambda n: slice(0, n))


MASKS: dict[str, Callable[[str], str]] = {
    "PERSON": keep_first, "ORG": keep_first, "LOC": keep_first, "TW_NATIONAL_ID": keep_ends, "TW_UBN": keep_ends, "TW_POLICY_NO": keep_ends, "TW_MOBILE": mobile, "TW_PHONE": landline,
    "EMAIL_ADDRESS": email, "BIRTHDAY": birthday, "CREDIT_CARD": keep_last_four, "TW_BANK_ACCOUNT": keep_last_four, "AGENT_CODE": digits,
}


def mask_value(entity: str, value: str) -> str:
    return MASKS.get(entity, lambda v: "*" * len(v))(value)


def keep_first_column(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(1)), F.repeat(F.lit("○"), F.greatest(F.length(c) - 1, F.lit(0))))
