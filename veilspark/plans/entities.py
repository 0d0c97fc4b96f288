"""The entities, their tags in placeholders, and the rules that find them, as data.

A rule is a pattern, a function from the match and the text to a score (None means no span), and a cheap condition on the
text without which the pattern cannot match. Digits are any Unicode decimal digits unless a pattern says [0-9].

More rules can be given to a call (see rule()); their entities need not be in the catalogue.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from typing import NamedTuple

# Entity names and the tags that stand for them in placeholders.
TAGS = {
    "PERSON": "PERSON",
    "ORG": "ORG",
    "LOC": "LOC",
    "TW_NATIONAL_ID": "TW_ID",
    "TW_MOBILE": "MOBILE",
    "TW_PHONE": "PHONE",
    "TW_UBN": "UBN",
    "EMAIL_ADDRESS": "EMAIL",
    "BIRTHDAY": "BIRTHDAY",
    "TW_POLICY_NO": "POLICY",
    "CREDIT_CARD": "CARD",
    "AGENT_CODE": "AGENT",
    "TW_BANK_ACCOUNT": "ACCOUNT",
}
# Words that make a number nearby what it seems to be.
CONTEXT = {
    "TW_UBN": ("統編", "統一編號", "營利事業", "買受人", "賣方", "公司統編"),
    "BIRTHDAY": ("生日", "出生", "生於"),
    "TW_POLICY_NO": ("保單", "保號", "契約", "保件"),
    "TW_BANK_ACCOUNT": ("帳號", "帳戶", "匯款", "轉帳", "匯入", "郵局"),
}
# A number broken over lines is a landline only near one of these.
PHONE_WORDS = ("手機", "電話", "門號", "聯絡", "致電", "回電", "撥", "分機", "簡訊")
# The letters of national IDs in the order of their codes from 10 on.
ID_LETTERS = "ABCDEFGHJKLMNPQRSTUVXYWZIO"
THRESHOLD = 0.5
MAX_CHARS = 50_000


class Span(NamedTuple):
    entity: str
    start: int
    end: int
    score: float
    recognizer: str
    order: int


class Look(NamedTuple):
    """What a text has: all its digits, and the most of them in a row."""

    text: str
    digits: int
    longest: int


class Rule(NamedTuple):
    entity: str
    name: str
    pattern: re.Pattern
    judge: Callable[[str, bool], float | None]
    may: Callable[[Look], bool]
    context: tuple[str, ...]
    weak: bool = False  # below THRESHOLD without a word nearby
    fixed: float | None = None  # the score, where it is always the same


_DIGITS = re.compile(r"\d+")


def look(text: str) -> Look:
    runs = [len(r) for r in _DIGITS.findall(text)]
    return Look(text, sum(runs), max(runs, default=0))


def _digits(value: str) -> list[int]:
    return [int(c) for c in value if c.isdecimal()]


def national_id_ok(value: str) -> bool:
    code, rest = 10 + ID_LETTERS.index(value[0]), _digits(value[1:])
    weighted = zip([*divmod(code, 10), *rest], (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1))
    return len(rest) == 9 and sum(d * w for d, w in weighted) % 10 == 0


def business_number_ok(value: str) -> bool:
    d = _digits(value)
    total = sum(sum(divmod(x * w, 10)) for x, w in zip(d, (1, 2, 1, 2, 1, 2, 4, 1)))
    return total % 5 == 0 or d[6] == 7 and (total + 1) % 5 == 0


def luhn_ok(value: str) -> bool:
    d = _digits(value)[::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def minguo_date_ok(value: str) -> bool:
    d = "".join(map(str, _digits(value)))
    try:
        datetime.date(int(d[:-4]) + 1911, int(d[-4:-2]), int(d[-2:]))
    except ValueError:
        return False
    return True


def rule(entity: str, name: str, pattern: str, judge: Callable[[str, bool], float | None] | float, may: Callable[[Look], bool] = lambda t: True, context: tuple[str, ...] = (), weak: bool = False) -> Rule:
    """judge: a score, or a function of the match and of whether a word of `context` is near."""
    return Rule(entity, name, re.compile(pattern), judge if callable(judge) else lambda v, c: judge, may, context or CONTEXT.get(entity, ()), weak, None if callable(judge) else judge)


def _run(n: int) -> Callable[[Look], bool]:
    return lambda t: t.longest >= n


def _all(n: int) -> Callable[[Look], bool]:
    return lambda t: t.digits >= n


def _has(part: str) -> Callable[[Look], bool]:
    return lambda t: part in t.text


def _alone(first: str, rest: str, left: str = "0-9A-Za-z", right: str = "0-9A-Za-z") -> str:
    """first (of one character), then rest, with none of left before and none of right after. As first leads, the search goes
    from one such character to the next; with a condition in front it would stop at each character."""
    return f"{first}(?<![{left}]{first})(?:{rest})(?![{right}])"


_GAP = "[- 　]"
_HAN = "[一-鿿]"

# Fixed value: the grammar of an address, up to the house number and beyond.
ADDRESS = (
    rf"(?:{_HAN}{{1,3}}[市縣])?(?:{_HAN}{{1,3}}[區鄉鎮市])?{_HAN}{{1,4}}(?:路|街|大道)(?:[一二三四五六七八九十\d]{{1,3}}段)?"
    r"(?:\d{1,4}巷)?(?:\d{1,4}弄)?\d{1,5}(?:之\d{1,3})?號(?:之\d{1,3})?(?:[Bb]?\d{1,3}樓(?:之\d{1,3})?)?(?:\d{1,4}室)?"
)

RULES: tuple[Rule, ...] = (
    rule("TW_NATIONAL_ID", "NationalId", _alone("[A-Z]", r"[1289]\d{8}"), lambda v, c: 0.95 if national_id_ok(v) else 0.1, _run(9)),
    rule("TW_MOBILE", "Mobile", _alone("0", r"9\d{8}"), 0.85, _run(10)),
    rule("TW_MOBILE", "Mobile", _alone("0", r"9\d\d-\d{3}-?\d{3}", "0-9A-Za-z-", "0-9A-Za-z-"), 0.85, lambda t: t.digits >= 10 and "-" in t.text),
    rule("TW_PHONE", "Landline", _alone("[(0]", rf"(?:(?<=\()0[2-8]\d{{0,2}}\)|(?<=0)[2-8]\d{{0,2}}{_GAP})\d{{2,4}}{_GAP}?\d{{4}}", "0-9A-Za-z(-"), 0.75, _all(8)),
    rule("TW_PHONE", "LandlineBare", _alone("0", r"[2-8]\d{7,8}", "0-9A-Za-z(-", "0-9"), 0.45, _run(9), weak=True),
    rule("TW_UBN", "BusinessNumber", _alone(r"\d", r"\d{7}"), lambda v, c: (0.95 if c else 0.45) if business_number_ok(v) else (0.1 if c else None), _run(8), weak=True),
    rule("EMAIL_ADDRESS", "Email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])", 1.0, _has("@")),
    rule("BIRTHDAY", "MinguoBirthday", r"(?<!\d)(?:1[0-2]\d|0[1-9]|[1-9]\d)\d{4}(?!\d)", lambda v, c: (0.95 if c else 0.45) if minguo_date_ok(v) else None, _run(6), weak=True),
    rule("TW_POLICY_NO", "PolicyNumber", _alone("[A-Z]", r"[A-Z]\d{8}|[A-Z]{2}\d{7}|[A-Z]{3}\d{6}|[A-Z]{4}\d{5}"), lambda v, c: 0.95 if c else 0.7, _run(5)),
    rule("TW_POLICY_NO", "PolicyNumber", _alone(r"\d", r"\d{9}"), lambda v, c: 0.95 if c else 0.45, _run(10), weak=True),
    rule("CREDIT_CARD", "PaymentCard", _alone(r"\d", r"\d{15}|\d{3}-\d{4}-\d{4}-\d{4}", "0-9A-Za-z-", "0-9A-Za-z-"), lambda v, c: 0.95 if luhn_ok(v) else 0.1, _all(16)),
    rule("AGENT_CODE", "AgentCode", r"代號[:：]?\s?\d{2,3}(?!\d)", 0.9, _has("代號")),
    rule("TW_BANK_ACCOUNT", "BankAccount", _alone(r"\d", r"\d{12,13}"), lambda v, c: 0.95 if c else 0.75, _run(13)),
    rule("LOC", "Address", ADDRESS, 0.9, _has("號")),
)


def chosen(entities: list[str] | None, extra: tuple[Rule, ...] = ()) -> list[str]:
    """The known entities of a selection, in the order of the catalogue; None selects all, an empty result is an error."""
    got = [e for e in dict.fromkeys([*TAGS, *(r.entity for r in extra)]) if entities is None or e in entities]
    if not got:
        raise ValueError("no known entity is selected")
    return got
