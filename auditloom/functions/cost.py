"""How long a search for a text pattern can take, by its form.

A backtracking search takes as many steps as there are ways to read the line. `growth`
bounds them by a power of the line's length, or says that there is no such bound
(a repeat of something that can itself be read in several ways), or that it does not know
(back references, conditions). From that follows up to which length of line a pattern may
run where nothing can stop it.

A repeat of characters that the next thing cannot begin with has one way to end, so it
costs its length once; any other repeat of unbounded length multiplies the ways by the
line's length. Sets of characters are compared over all of Unicode.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sc
from re import _parser as sp

import numpy as np

#: Steps that a search may take where it can't be stopped: below half a second on slow machines.
STEPS = 20_000_000
#: Repeats beyond this count as unbounded; ways beyond this count as too many.
LONG_REPEAT, MANY = 64, 100_000


class Unknown(Exception):
    """The form does not tell."""


@dataclass
class _Part:
    ways: int = 0  # power of the length by which the ways to read grow
    work: int = 0  # power by which the steps from one start grow
    times: int = 1  # constant factor


@lru_cache(maxsize=4)
def _alphabet() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@lru_cache(maxsize=4096)
def _members(source: str, flags: int) -> np.ndarray:
    """Which characters one item of a pattern takes, as bits by code point."""
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in re.findall(source, _alphabet(), flags)]] = True
    return out


def _item(op, arg, flags: int) -> np.ndarray | None:
    """The characters of an item that takes exactly one; None for other items."""
    escaped = lambda n: f"\\U{n:08x}"
    if op is sc.LITERAL:
        return _members(escaped(arg), flags)
    if op is sc.NOT_LITERAL:
        return _members(f"[^{escaped(arg)}]", flags)
    if op is sc.ANY:
        return _members(".", flags)
    if op is sc.IN:
        names = {sc.CATEGORY_DIGIT: r"\d", sc.CATEGORY_NOT_DIGIT: r"\D", sc.CATEGORY_SPACE: r"\s", sc.CATEGORY_NOT_SPACE: r"\S", sc.CATEGORY_WORD: r"\w", sc.CATEGORY_NOT_WORD: r"\W"}
        body = ""
        for kind, x in arg:
            if kind is sc.NEGATE:
                body += "^"
            elif kind is sc.LITERAL:
                body += escaped(x)
            elif kind is sc.RANGE:
                body += f"{escaped(x[0])}-{escaped(x[1])}"
            elif kind is sc.CATEGORY and x in names:
                body += names[x]
            else:
                raise Unknown(kind)
        return _members(f"[{body}]", flags)
    return None


def _first(items: list, flags: int) -> tuple[np.ndarray, bool]:
    """What a sequence can begin with, and whether it can be empty."""
    out = np.zeros(0x110000, bool)
    for op, arg in items:
        one = _item(op, arg, flags)
        if one is not None:
            return out | one, False
        if op is sc.AT or op in (sc.ASSERT, sc.ASSERT_NOT):
            continue
        if op is sc.SUBPATTERN:
            chars, empty = _first(list(arg[3]), flags)
        elif op is sc.BRANCH:
            each = [_first(list(a), flags) for a in arg[1]]
            chars, empty = np.logical_or.reduce([c for c, _ in each]), any(e for _, e in each)
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT, sc.POSSESSIVE_REPEAT):
            chars, empty = _first(list(arg[2]), flags)
            empty = empty or arg[0] == 0
        elif op is sc.ATOMIC_GROUP:
            chars, empty = _first(list(arg), flags)
        else:
            raise Unknown(op)
        out = out | chars
        if not empty:
            return out, False
    return out, True


def _walk(items: list, flags: int, after: np.ndarray | None, last: bool) -> _Part:
    """after: what may follow (None: anything); last: whether the search ends where the sequence does."""
    whole = _Part()
    for k, (op, arg) in enumerate(items):
        chars, empty = _first(items[k + 1 :], flags)
        follows = chars if not empty else None if after is None else chars | after
        ends = last and k == len(items) - 1
        one = _one(op, arg, flags, follows, ends)
        whole.work = max(whole.work, whole.ways + one.work)
        whole.ways += one.ways
        whole.times *= one.times
        if whole.times > MANY:
            raise Unknown("too many ways")
    whole.work = max(whole.work, whole.ways)
    return whole


def _one(op, arg, flags: int, follows: np.ndarray | None, ends: bool) -> _Part:
    if op is sc.AT or _item(op, arg, flags) is not None:
        return _Part()
    if op is sc.SUBPATTERN:
        if arg[1] or arg[2]:
            raise Unknown("flags within the pattern")
        return _walk(list(arg[3]), flags, follows, ends)
    if op is sc.ATOMIC_GROUP:
        inner = _walk(list(arg), flags, None, False)
        return _Part(0, max(inner.work, inner.ways), inner.times)
    if op is sc.BRANCH:
        each = [_walk(list(a), flags, follows, ends) for a in arg[1]]
        return _Part(max(p.ways for p in each), max(p.work for p in each), sum(p.times for p in each))
    if op in (sc.ASSERT, sc.ASSERT_NOT):
        inner = _walk(list(arg[1]), flags, None, True)
        return _Part(0, max(inner.work, inner.ways), inner.times)
    if op in (sc.MAX_REPEAT, sc.MIN_REPEAT, sc.POSSESSIVE_REPEAT):
        return _repeat(op, *arg, flags, follows, ends)
    raise Unknown(op)


def _repeat(op, low: int, high, body, flags: int, follows: np.ndarray | None, ends: bool) -> _Part:
    body = list(body)
    chars, empty = _first(body, flags)
    inner = _walk(body, flags, None if follows is None else follows | chars, False)
    long_ = high is sc.MAXREPEAT or int(high) > LONG_REPEAT
    # One way to go on from every place: another round, or what follows, but never both.
    sure = op is sc.POSSESSIVE_REPEAT or ends and op is sc.MAX_REPEAT or follows is not None and not (follows & chars).any()
    if low == high == 1:
        return inner
    if empty and long_ or (inner.ways or inner.times > 1 and not _alike(body, flags)) and long_:
        raise Unknown("a repeat of what can be read in several ways")
    if long_:
        return _Part(0 if sure else 1, 1 + inner.work, 1)
    rounds = max(1, int(high))
    if inner.ways:
        return _Part(inner.ways * rounds, inner.work + inner.ways * rounds, inner.times**rounds)
    times = inner.times**rounds if not _alike(body, flags) else 1
    return _Part(0, inner.work, times * (1 if sure else int(high) - low + 1) + rounds)


def _alike(body: list, flags: int) -> bool:
    """Whether a choice's alternatives begin with different characters, so that only one can be meant."""
    if len(body) == 1 and body[0][0] is sc.SUBPATTERN:
        return _alike(list(body[0][1][3]), flags)
    if len(body) == 1 and body[0][0] is sc.BRANCH:
        seen = np.zeros(0x110000, bool)
        for a in body[0][1][1]:
            part, (chars, empty) = _walk(list(a), flags, None, False), _first(list(a), flags)
            if part.ways or part.times > 1 or empty or (seen & chars).any():
                return False
            seen |= chars
        return True
    return _item(*body[0], flags) is not None if len(body) == 1 else False


def growth(pattern: str) -> tuple[int, int] | None:
    """(power, factor): a search in n characters takes at most factor * n**power steps. None without such a bound."""
    try:
        parsed = sp.parse(pattern)
        flags = parsed.state.flags & (re.I | re.A | re.S | re.M | re.X | re.L)
        items = list(parsed)
        part = _walk(items, flags & ~re.X, None, True)
        anchored = bool(items) and items[0][0] is sc.AT and items[0][1] in (sc.AT_BEGINNING, sc.AT_BEGINNING_STRING)
        return part.work + (0 if anchored else 1), part.times * max(1, len(pattern))
    except Unknown:
        return None


@lru_cache(maxsize=4096)
def longest_line(pattern: str, steps: int = STEPS) -> int:
    """Up to how many characters a line may have for the pattern's search to stay below the steps; -1, so none, if that is unknown."""
    g = growth(pattern)
    if g is None:
        return -1
    power, factor = g
    return 1 << 30 if not power else min(1 << 30, int((steps / factor) ** (1 / power)))
