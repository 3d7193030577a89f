"""The functions of ``regex`` over patterns that are compiled once.

``regex.search(pattern, ..)`` and its like check flags and version before they find the compiled pattern, which takes longer
than the search itself in a text of a few lines. Here pattern and flags are the key.
"""

from __future__ import annotations

from functools import lru_cache

import regex

I, M, S = int(regex.I), int(regex.M), int(regex.S)  # noqa: E741

#: Patterns that hold a year or a number of a text are compiled too; the least recently used go.
compile = lru_cache(4096)(regex.compile)


def search(pattern: str, text: str, flags: int = 0):
    return compile(pattern, flags).search(text)


def match(pattern: str, text: str, flags: int = 0):
    return compile(pattern, flags).match(text)


def fullmatch(pattern: str, text: str, flags: int = 0):
    return compile(pattern, flags).fullmatch(text)


def finditer(pattern: str, text: str, flags: int = 0):
    return compile(pattern, flags).finditer(text)


def findall(pattern: str, text: str, flags: int = 0) -> list:
    return compile(pattern, flags).findall(text)


def sub(pattern: str, new, text: str, count: int = 0, flags: int = 0) -> str:
    return compile(pattern, flags).sub(new, text, count)


def split(pattern: str, text: str, maxsplit: int = 0, flags: int = 0) -> list:
    return compile(pattern, flags).split(text, maxsplit)
