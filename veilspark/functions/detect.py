"""The span kernel: from a text to its resolved, disjoint findings. Plain Python, run in Arrow batches by operators.scrub.

Short texts of a batch are looked through in one go (found_all): a rule then costs a call for a batch, not for each text.
What is found stays in columns; only where findings of a text overlap are spans made and resolved one by one."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Sequence
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np

from ..plans.entities import PHONE_WORDS, RULES, THRESHOLD, Rule, Span, look
from .normalise import BREAKS, WIDE_DIGIT, Shadow

#: Characters before and after a match in which context words count.
AROUND = (15, 8)
PHONE_AROUND = 15
#: Texts up to this many characters are looked through together. In longer ones the guards of rules save more.
SHORT = 500
#: Stands between texts. No pattern of RULES matches it, and for all their lookarounds it is as the end of a text.
_BETWEEN = "\0"
_NEAR = {r.context: re.compile("|".join(map(re.escape, r.context))) for r in RULES if r.context}
_CHANGES = re.compile(f"[{BREAKS}０-９]")
_BREAK = re.compile(f"[{BREAKS}]")
_PHONES = np.array([r.entity == "TW_PHONE" for r in RULES])


class Found(NamedTuple):
    """Findings of many texts as columns, by text and place. of: the index of the text; order: that of the rule in RULES."""

    of: np.ndarray
    start: np.ndarray
    end: np.ndarray
    score: np.ndarray
    order: np.ndarray

    def at(self, places) -> Found:
        return Found(*(c[places] for c in self))

    def spans(self) -> list[Span]:
        return [Span(RULES[o].entity, a, b, score, RULES[o].name, o) for a, b, score, o in zip(*(c.tolist() for c in self[1:]))]


def _together(parts: Iterable[Found]) -> Found:
    return Found(*map(np.concatenate, zip(*parts)))


def _of_spans(spans: dict[int, list[Span]]) -> Found:
    each = [(k, s.start, s.end, s.score, s.order) for k, own in spans.items() for s in own]
    columns = zip(*each) if each else ((),) * 5
    return Found(*(np.array(c, np.float64 if n == "score" else np.int64) for n, c in zip(Found._fields, columns)))


def extract(text: str, wanted: set[str], extra: Sequence[Rule] = ()) -> list[Span]:
    """All spans of the rules, whatever their score."""
    out: list[Span] = []
    separated: list[Span] = []
    seen = look(text)
    for order, rule in enumerate((*RULES, *extra)):
        if rule.entity not in wanted or not rule.may(seen):
            continue
        for m in rule.pattern.finditer(text):
            near = bool(rule.context) and any(w in text[max(0, m.start() - AROUND[0]) : m.end() + AROUND[1]] for w in rule.context)
            score = rule.judge(m.group(), near)
            if score is None or m.start() == m.end():
                continue
            span = Span(rule.entity, m.start(), m.end(), score, rule.name, order)
            if rule.name == "Landline":
                separated.append(span)
            elif rule.name == "LandlineBare" and any(s.start <= span.start and span.end <= s.end for s in separated):
                continue
            out.append(span)
    return out


def without_contained(spans: list[Span]) -> list[Span]:
    """Without spans inside one of the same entity with at least their score (of equal ones the first stays).

    From left to right, longest first: what could hold a span is then behind it, and of those only the ones that no later
    span beats in both reach and score."""
    out: list[tuple[int, Span]] = []
    reach: dict[str, list[tuple[int, float]]] = {}  # by entity: ends fall as scores rise
    for k, s in sorted(enumerate(spans), key=lambda x: (x[1].start, -x[1].end, -x[1].score, x[0])):
        best = reach.setdefault(s.entity, [])
        if any(end >= s.end and score >= s.score for end, score in best):
            continue
        best[:] = [x for x in best if x[0] > s.end or x[1] > s.score]
        best.append((s.end, s.score))
        out.append((k, s))
    return [s for _, s in sorted(out)]


def resolve(spans: Iterable[Span]) -> list[Span]:
    """Disjoint spans, in the order of the text. Who comes first keeps its place: the higher score, then the longer, then the
    one further left. What is taken stands in order, so a newcomer meets at most its two neighbours there."""
    starts: list[int] = []
    taken: list[Span] = []
    for s in sorted(spans, key=lambda x: (-x.score, x.start - x.end, x.start, x.order)):
        k = bisect_left(starts, s.end)
        # all from k on begin behind s; the one before k ends last of those that begin before s ends
        if k and taken[k - 1].end > s.start:
            continue
        starts.insert(k, s.start)
        taken.insert(k, s)
    return taken


def _allowed(text: str, span: Span, terms: list[str]) -> bool:
    for term in terms:
        at = text.find(term, max(0, span.end - len(term)))
        while at >= 0 and at <= span.start:
            if span.end <= at + len(term):
                return True
            at = text.find(term, at + 1)
    return False


def _back(text: str, shadow: Shadow, spans: list[Span]) -> list[Span]:
    """Spans of the shadow at their places in the text."""
    spans = [s._replace(start=a, end=b) for s in spans for a, b in [shadow.back(s.start, s.end)]]
    return [s for s in spans if s.entity != "TW_PHONE" or not set(text[s.start : s.end]) & set(BREAKS) or any(w in text[max(0, s.start - PHONE_AROUND) : s.end + PHONE_AROUND] for w in PHONE_WORDS)]


def detect(text: str, wanted: set[str], allow: list[str] = (), join_broken: bool = True, ner: Callable[[str, set[str]], list[Span]] | None = None, extra: Sequence[Rule] = ()) -> list[Span]:
    """Findings in the order of the text, at its own offsets."""
    found = lambda t: [s for s in extract(t, wanted, extra) if s.score >= THRESHOLD]
    shadow = Shadow(text) if join_broken else None
    first = shadow.text if shadow else text
    spans = without_contained(found(first) + (ner(first, wanted) if ner else []))
    if shadow:
        spans = _back(text, shadow, spans)
        if first != text:
            spans += found(text)
    return resolve(s for s in spans if not allow or not _allowed(text, s, allow))


def _matches(joined: str, starts: np.ndarray, wanted: set[str]) -> Found:
    """What extract() finds with a score of THRESHOLD or more in texts that stand in `joined`, rule by rule, at its offsets."""
    parts, bounds = [_of_spans({})], starts.tolist()
    seen = look(joined)
    for order, rule in enumerate(RULES):
        if rule.entity not in wanted or not rule.may(seen):
            continue
        words = _NEAR.get(rule.context)
        if words and not words.search(joined):
            words = None
        if rule.weak and not words or rule.fixed is not None and rule.fixed < THRESHOLD:
            continue
        if rule.fixed is not None:
            places = [m.span() for m in rule.pattern.finditer(joined)]
            scores = [rule.fixed] * len(places)
        else:
            places, scores = [], []
            for m in rule.pattern.finditer(joined):
                near = False
                if words:
                    k = bisect_right(bounds, m.start()) - 1
                    near = words.search(joined, max(bounds[k], m.start() - AROUND[0]), min(bounds[k + 1] - 1, m.end() + AROUND[1])) is not None
                if rule.weak and not near:
                    continue
                score = rule.judge(m.group(), near)
                if score is not None and score >= THRESHOLD:
                    places.append(m.span())
                    scores.append(score)
        if places:
            at = np.fromiter(chain.from_iterable(places), np.int64, 2 * len(places)).reshape(-1, 2)
            parts.append(Found(np.searchsorted(starts, at[:, 0], "right") - 1, at[:, 0], at[:, 1], np.array(scores), np.full(len(places), order)))
    return _together(parts)


def _joined(texts: Sequence[str]) -> tuple[str, np.ndarray]:
    """The texts one after another, and where each begins; the last of these places is behind all."""
    return _BETWEEN.join(texts), np.fromiter(accumulate((len(t) + 1 for t in texts), initial=0), np.int64, len(texts) + 1)


def _found_short(texts: Sequence[str], wanted: set[str], allow: list[str], join_broken: bool) -> Found:
    joined, starts = _joined(texts)
    raw, dropped = _of_spans({}), np.zeros(0, np.int64)
    if join_broken and _CHANGES.search(joined):
        shadow = Shadow(joined)  # no value goes on over _BETWEEN
        at, gone = np.array(shadow.at, np.int64), np.array([0, *shadow.gone], np.int64)
        cuts = at + gone[:-1]
        inner = starts - gone[np.searchsorted(cuts, starts)]
        seen = _matches(shadow.text, inner, wanted)
        place = lambda p: p + gone[np.searchsorted(at, p, "right")]
        first = seen._replace(start=place(seen.start), end=place(seen.end - 1) + 1)
        marks = np.array([m.start() for m in WIDE_DIGIT.finditer(joined)], np.int64)
        changed = np.unique(np.searchsorted(starts, np.concatenate([cuts, marks]), "right") - 1)
        if len(changed):
            own, begins = _joined([texts[k] for k in changed])
            raw = _matches(own, begins, wanted)
            by = starts[changed[raw.of]] - begins[raw.of]
            raw = Found(changed[raw.of], raw.start + by, raw.end + by, raw.score, raw.order)
        breaks = np.array([m.start() for m in _BREAK.finditer(joined)], np.int64)
        odd = np.flatnonzero(_PHONES[first.order] & (np.searchsorted(breaks, first.start) < np.searchsorted(breaks, first.end)))
        dropped = first.of[odd]  # may lack a word nearby
    else:
        seen = first = _matches(joined, starts, wanted)
        inner = starts
    both = _together([first, raw])
    both = both.at(np.lexsort((both.score, both.order, both.end, both.start)))
    # the same finding in the joined and in the raw text counts once
    both = both.at(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in both], axis=0)])) if len(both.of) else both
    hard = np.unique(np.concatenate([dropped, both.of[1:][both.start[1:] < both.end[:-1]]]))
    if len(hard):
        both = both.at(~np.isin(both.of, hard))
    out = both._replace(start=both.start - starts[both.of], end=both.end - starts[both.of])
    if allow:
        out = out.at([not _allowed(texts[k], s, allow) for k, s in zip(out.of.tolist(), out.spans())])
    if len(hard):
        one = lambda f, begins: _by_text(f.at(np.isin(f.of, hard)), begins)
        spans, own = one(seen, inner), one(raw, starts)
        out = _together([out, _of_spans({k: _settled(texts[k], spans.get(k, []), own.get(k, []), allow, join_broken) for k in hard.tolist()})])
    return out


def _by_text(found: Found, starts: np.ndarray) -> dict[int, list[Span]]:
    out: dict[int, list[Span]] = {}
    for k, s in zip(found.of.tolist(), found._replace(start=found.start - starts[found.of], end=found.end - starts[found.of]).spans()):
        out.setdefault(k, []).append(s)
    return out


def _settled(text: str, spans: list[Span], raw: list[Span], allow: list[str], join_broken: bool) -> list[Span]:
    spans = without_contained(spans)
    if join_broken and _CHANGES.search(text):
        spans = _back(text, Shadow(text), spans) + raw
    return resolve(s for s in spans if not allow or not _allowed(text, s, allow))


def found_all(texts: Sequence[str | None], wanted: set[str], allow: list[str] = (), join_broken: bool = True) -> Found:
    """detect() of each text, none for null."""
    short = np.array([k for k, t in enumerate(texts) if t is not None and len(t) <= SHORT], np.int64)
    found = _found_short([texts[k] for k in short], wanted, allow, join_broken)
    long = {k: detect(t, wanted, allow, join_broken) for k, t in enumerate(texts) if t is not None and len(t) > SHORT}
    out = _together([found._replace(of=short[found.of]), _of_spans(long)])
    return out.at(np.argsort(out.of, kind="stable"))


def detect_all(texts: Sequence[str | None], wanted: set[str], allow: list[str] = (), join_broken: bool = True) -> list[list[Span]]:
    """found_all() as spans."""
    found = found_all(texts, wanted, allow, join_broken)
    own = _by_text(found, np.zeros(len(texts), np.int64))
    return [own.get(k, []) for k in range(len(texts))]
