"""Long texts in stretches that are worked one after the other."""

from __future__ import annotations

from collections.abc import Iterator

import regex

#: A place where words of ASCII letters, digits and characters above U+007F end.
WORD_END = regex.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: A place where words between ASCII white space end.
BLANK = regex.compile(r"[\x20\x09-\x0D]")


def stretches(text: str, limit: int, place: regex.Pattern) -> Iterator[str]:
    """The text in parts of ``limit`` characters or more, each but the first beginning where ``place`` matches.

    Cuts are at the first match behind the limit and nowhere else: a part is as
    long as it has to be. The parts joined are the text; an empty text is one part.
    """
    start = 0
    while len(text) - start > limit and (cut := place.search(text, start + limit)) is not None:
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]
