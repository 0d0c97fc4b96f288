"""Texts in which broken numbers are whole again, and the way back to the original."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters at which a value may be broken.
BREAKS = " 　\r\n"
WIDE_DIGIT = re.compile("[０-９]")
_WIDE = str.maketrans("０１２３４５６７８９", "0123456789")
_BEFORE, _AFTER = "[0-9A-Za-z@._]", "(?=[0-9A-Za-z@._])"
_RUN = rf"(?:[ 　]|(?=[{BREAKS}]{{1,3}}(?![{BREAKS}]))[ 　]*(?:\r\n|\n|\r)[ 　]*)"
_BREAKS = re.compile(f"[{BREAKS}]+")
_JOIN = re.compile(rf"(?:(?<={_BEFORE})|(?<=[0-9A-Za-z]-)){_RUN}{_AFTER}")


class Shadow:
    """text: joined, with plain digits; back() gives the place in the original of a span in it."""

    def __init__(self, text: str):
        self.at, self.gone, gone, parts, end = [], [], 0, [], 0
        # a join takes in all breaks in a row
        for m in filter(None, (_JOIN.match(text, b.start()) for b in _BREAKS.finditer(text))):
            parts.append(text[end : m.start()])
            self.at.append(m.start() - gone)
            gone += m.end() - m.start()
            self.gone.append(gone)
            end = m.end()
        text = "".join(parts) + text[end:]
        self.text = text.translate(_WIDE) if WIDE_DIGIT.search(text) else text

    def _place(self, p: int) -> int:
        k = bisect_right(self.at, p)
        return p + (self.gone[k - 1] if k else 0)

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start), self._place(end - 1) + 1


def canonical(value: str) -> str:
    return value.translate({ord(c): None for c in BREAKS})


def canonical_column(c: Column) -> Column:
    return F.translate(c, BREAKS, "")


def shadow_text(c: Column) -> Column:
    """The joined text, as detection sees it."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([Shadow(t).text if t is not None else None for t in texts.to_pylist()], pa.string())

    return run(c)
