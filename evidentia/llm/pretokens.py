"""Splitting text into the pieces that byte-level BPE merges within."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Letters of the Latin blocks, for which the plain pattern below equals the public one.
LATIN = "a-zA-ZÀ-ÖØ-öø-ɏ"
_plain = re.compile(rf"[\t\n\r\x20-\x7e{LATIN}]*").fullmatch
_latin = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+").findall


def splitter(pattern: str, fixed: str) -> Callable[[str], list[str]]:
    """findall of pattern.  fixed: the public pattern, which texts of Latin letters split faster."""
    general = regex.compile(pattern).findall
    if pattern != fixed:
        return general
    return lambda text: _latin(text) if _plain(text) else general(text)


class Memo(dict):
    """A bounded memo of function(key): when full it becomes the old generation, from which
    what is still asked for moves up again."""

    def __init__(self, function: Callable, most: int) -> None:
        super().__init__()
        self.function, self.most, self.old = function, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
