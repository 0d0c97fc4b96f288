"""Named entities: the interface of a provider, chunking of long texts, and a small rule-based stand-in.

A provider is called with a text and the wanted entities and returns spans. A model comes in by by_chunks(): it sees chunks in
batches, must stay within a deadline, and every name it reports is verified against the text, so a shifted offset is put
right or is an error, never a wrong mask. Model weights are not part of this repository; RuleNer knows common surnames and
endings of organisations only, and is no equal of a trained model.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

from ..plans.entities import Span

CHUNK, OVERLAP, BATCH, SCORE = 400, 30, 8, 0.85
SECONDS = 60.0
_ENDS = "。！？!?\n；;"
# An own choice of frequent surnames.
SURNAMES = "陳林黃張李王吳劉蔡楊許鄭謝郭洪曾邱廖賴周徐蘇葉莊呂江何蕭羅高"
# An own choice of what names of organisations end in.
ORGANISATIONS = ("股份有限公司", "有限公司", "人壽", "銀行", "醫院", "大學")


def chunks(text: str, most: int = CHUNK) -> Iterator[tuple[int, str]]:
    """(offset, chunk): cut after the last end of a sentence within `most` characters; together they are the text."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            last = max(text.rfind(c, at, end) for c in _ENDS)
            end = last + 1 if last >= at else end
        yield at, text[at:end]
        at = end


class NerTimeout(RuntimeError):
    pass


def by_chunks(find: Callable[[list[str]], list[list[tuple[str, str, int]]]], name: str, seconds: float = SECONDS) -> Callable[[str, set[str]], list[Span]]:
    """A provider from find(chunks) -> for each chunk (entity, value, start), ...: chunks see OVERLAP characters around them
    and own what starts inside; BATCH chunks go to find() at once. Past `seconds` for a text, NerTimeout ends the query."""

    def run(text: str, wanted: set[str]) -> list[Span]:
        if not text.strip() or not wanted & {"PERSON", "ORG", "LOC"}:
            return []
        until, out, parts = time.monotonic() + seconds, [], list(chunks(text))

        def check() -> None:
            if time.monotonic() > until:
                raise NerTimeout(f"{name} took more than {seconds} s")

        for k in range(0, len(parts), BATCH):
            some = parts[k : k + BATCH]
            check()
            seen = [(max(0, at - OVERLAP), at + len(part) + OVERLAP) for at, part in some]
            answers = find([text[a:b] for a, b in seen])
            check()
            if len(answers) != len(some):
                raise ValueError("not an answer for each chunk")
            for (at, part), (left, right), names in zip(some, seen, answers):
                for entity, value, start in names:
                    if entity in wanted:
                        s, e = realign(text[left:right], value, start)
                        if at <= left + s < at + len(part):
                            out.append(Span(entity, left + s, left + e, SCORE, name, 99))
        return out

    return run


def realign(text: str, value: str, start: int, reach: int = 8) -> tuple[int, int]:
    """Where value really stands: at start, or its only place within `reach` characters; else an error."""
    if text[start : start + len(value)] == value:
        return start, start + len(value)
    low = max(0, start - reach)
    found = [k for k in range(low, min(len(text), start + reach + 1)) if text.startswith(value, k)]
    if len(found) != 1:
        raise ValueError("a span doesn't fit its text")
    return found[0], found[0] + len(value)


_PERSON = re.compile(f"(?<![一-鿿])[{SURNAMES}][一-鿿]{{2}}(?![一-鿿])")
_ORG = re.compile("[一-鿿]{2,6}(?:" + "|".join(ORGANISATIONS) + ")")


def _rules(parts: list[str]) -> list[list[tuple[str, str, int]]]:
    return [[(kind, m.group(), m.start()) for kind, p in (("PERSON", _PERSON), ("ORG", _ORG)) for m in p.finditer(text)] for text in parts]


rule_ner = by_chunks(_rules, "RuleNer")
