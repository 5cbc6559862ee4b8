"""Personal data by pattern, and the passages of a text, for one worker."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

#: Kinds in the order in which spans of one start are listed; ``term`` spans come from the corpus.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL, IP, CARD, PHONE, TERM_KIND = range(5)

# The patterns. Possessive and looking behind, they read a text once however long its runs are.
LOCAL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
EMAIL_HERE, EMAIL_NEXT = re.compile(LOCAL), re.compile(r"(?<![A-Za-z0-9._%+-])" + LOCAL)
IP_RUN = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE_RUN = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: A term: letters and digits, four at least. A passage ends with its line or sentence, or after so many terms.
TERM, BREAK, PASSAGE_TERMS = re.compile(r"[^\W_]{4,}+"), re.compile(r"\n|[.!?](?=\s)"), 32


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[re.Match]:
    at = 0
    while found := EMAIL_HERE.match(text, at) or EMAIL_NEXT.search(text, at):
        yield found
        at = found.end()


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Matches of every kind that hold, by start, then kind."""
    found = [Span(m.start(), EMAIL, m.end()) for m in _emails(text)] if "@" in text else []
    found += [Span(m.start(), IP, m.end()) for m in IP_RUN.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD_RUN.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(Span(m.start(), CARD, m.end()))
    for m in PHONE_RUN.finditer(text) if "+" in text else ():
        if 10 <= len(DIGIT.findall(m[0])) <= 15:
            found.append(Span(m.start(), PHONE, m.end()))
    return sorted(found)


def entity(text: str, span: Span) -> str:
    """What a span names, however it is written: an address in lower case, a number by its digits."""
    raw = text[span.start : span.end]
    return KINDS[span.kind] + ":" + ("".join(DIGIT.findall(raw)) if span.kind in (CARD, PHONE) else raw.lower())


class Passage(NamedTuple):
    start: int
    end: int
    terms: list[tuple[int, int]]


def passages(text: str) -> Iterator[Passage]:
    """Passages that hold terms, in order: a line or sentence, cut after every ``PASSAGE_TERMS`` terms."""
    ends = [m.end() for m in BREAK.finditer(text)]
    ends.append(len(text))
    at, start, held = 0, 0, []
    for m in TERM.finditer(text):
        if m.start() >= ends[at]:
            if held:
                yield Passage(start, ends[at], held)
                held = []
            at = bisect_right(ends, m.start(), at)
            start = ends[at - 1]
        held.append(m.span())
        if len(held) == PASSAGE_TERMS:
            yield Passage(start, m.end(), held)
            start, held = m.end(), []
    if held:
        yield Passage(start, ends[at], held)


class Covered:
    """Whether a stretch of a text overlaps one of its spans."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for span in spans:
            if self.ends and span.start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], span.end)
            else:
                self.starts.append(span.start)
                self.ends.append(span.end)

    def __call__(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, end - 1) - 1
        return at >= 0 and self.ends[at] > start
