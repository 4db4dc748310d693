"""A packrat parser for parsing-expression grammars over source text.

Expressions are closures ``(text, at, memo) -> (end, values) | None``; a ``Rule`` remembers its result at each place, so
that backtracking over a rule costs one lookup. Terminals are regular expressions. Values are what semantic actions return,
with the source offsets they cover.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

class End(NamedTuple):
    """Where a part that was looked at ahead ends."""

    at: int


Result = tuple[int, list[Any]] | None
Expr = Callable[[str, int, dict], Result]
_NO: list[Any] = []


def tok(pattern: str, flags: int = re.M) -> Expr:
    """A terminal without a value."""
    match = re.compile(pattern, flags).match

    def run(text: str, at: int, memo: dict) -> Result:
        m = match(text, at)
        return None if m is None else (m.end(), _NO)

    return run


def take(pattern: str, action: Callable[[re.Match[str]], Any], flags: int = re.M) -> Expr:
    """A terminal whose value is ``action`` of its match."""
    match = re.compile(pattern, flags).match

    def run(text: str, at: int, memo: dict) -> Result:
        m = match(text, at)
        return None if m is None else (m.end(), [action(m)])

    return run


def seq(*parts: Expr) -> Expr:
    def run(text: str, at: int, memo: dict) -> Result:
        values: list[Any] = []
        for p in parts:
            r = p(text, at, memo)
            if r is None:
                return None
            at = r[0]
            if r[1]:
                values = values + r[1]
        return at, values

    return run


def alt(*choices: Expr) -> Expr:
    """Ordered choice."""

    def run(text: str, at: int, memo: dict) -> Result:
        for c in choices:
            r = c(text, at, memo)
            if r is not None:
                return r
        return None

    return run


def many(part: Expr, least: int = 0) -> Expr:
    """Greedy repetition; a part that consumes nothing ends it."""

    def run(text: str, at: int, memo: dict) -> Result:
        values: list[Any] = []
        n = 0
        while True:
            r = part(text, at, memo)
            if r is None or r[0] == at:
                break
            at = r[0]
            n += 1
            if r[1]:
                values.extend(r[1])
        return (at, values) if n >= least else None

    return run


def maybe(part: Expr) -> Expr:
    def run(text: str, at: int, memo: dict) -> Result:
        return part(text, at, memo) or (at, _NO)

    return run


def ahead(part: Expr) -> Expr:
    """Looks ahead without consuming."""

    def run(text: str, at: int, memo: dict) -> Result:
        return None if part(text, at, memo) is None else (at, _NO)

    return run


def extent(part: Expr) -> Expr:
    """Looks ahead, with the offset where ``part`` ends as the value."""
    def run(text: str, at: int, memo: dict) -> Result:
        r = part(text, at, memo)
        return None if r is None else (at, [End(r[0])])

    return run


def act(part: Expr, action: Callable[[list[Any], int, int], list[Any]]) -> Expr:
    """Replaces the values of ``part`` by ``action(values, start, end)``."""

    def run(text: str, at: int, memo: dict) -> Result:
        r = part(text, at, memo)
        return None if r is None else (r[0], action(r[1], at, r[0]))

    return run


class Rule:
    """A named expression, remembered at each place."""

    def __init__(self, name: str) -> None:
        self.name, self.body = name, None

    def __call__(self, text: str, at: int, memo: dict) -> Result:
        spot = (self.name, at)
        if spot in memo:
            return memo[spot]
        r = memo[spot] = self.body(text, at, memo)  # type: ignore[misc]
        return r


class Nested:
    """What stands between marks that open and close, however deep: ``inner`` is tried where no mark stands.

    Places of inner pairs are remembered like those of a rule, but found in one loop instead of by recursion. ``open_end``
    lets the end of the text close all.
    """

    def __init__(self, opening: str, closing: str, inner: Expr, open_end: bool = False) -> None:
        self.open, self.close, self.inner, self.open_end = re.compile(opening).match, re.compile(closing).match, inner, open_end

    def __call__(self, text: str, at: int, memo: dict) -> Result:
        first = (self, at)
        if first in memo:
            return memo[first]
        m = self.open(text, at)
        if m is None:
            return None
        begun, at = [first], m.end()
        while begun:
            if m := self.close(text, at):
                at = m.end()
                memo[begun.pop()] = (at, _NO)
            elif m := self.open(text, at):
                known = memo.get((self, at), self)
                if known is None:
                    break
                if known is not self:
                    at = known[0]
                    continue
                begun.append((self, at))
                at = m.end()
            else:
                r = self.inner(text, at, memo)
                if r is None or r[0] == at:
                    break
                at = r[0]
        for spot in begun:
            memo[spot] = (at, _NO) if self.open_end and at >= len(text) else None
        return memo[first]


def parse(grammar: Expr, text: str) -> list[Any]:
    """Values of ``grammar`` from the start of ``text``; what it doesn't consume has none."""
    r = grammar(text, 0, {})
    return [] if r is None else r[1]
