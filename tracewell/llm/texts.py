"""Texts in portions of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

#: Characters that are worked on at once.
PORTION = 1_000_000
_BREAK = re.compile(r"[ \t\n\r]")


def parts_of(text: str, size: int = PORTION) -> Iterator[str]:
    """A text cut at white space into parts of about ``size`` characters."""
    at = 0
    while len(text) - at > size:
        m = _BREAK.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def portions(texts: Iterable[str], size: int = PORTION) -> Iterator[list[str]]:
    """Lists of texts of about ``size`` characters in all; a longer text is alone."""
    held: list[str] = []
    n = 0
    for text in texts:
        if held and n + len(text) > size:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held
