"""Levenshtein distance of two strings, in time by their length where they are close."""

from __future__ import annotations

from math import isqrt


def shared(a: str, i: int, b: str, j: int) -> int:
    """How many characters are equal from a[i] and b[j] on: compared in steps that double, then halve."""
    top, at, step = min(len(a) - i, len(b) - j), 0, 1
    while at + step <= top and a[i + at : i + at + step] == b[j + at : j + at + step]:
        at += step
        step *= 2
    while step := step >> 1:
        if at + step <= top and a[i + at : i + at + step] == b[j + at : j + at + step]:
            at += step
    return at


def by_diagonals(a: str, b: str, most: int) -> int | None:
    """The distance if it is `most` or less: for each number of edits, how far each diagonal gets (Ukkonen; Landau and Vishkin)."""
    n, m = len(a), len(b)
    goal = n - m
    if abs(goal) > most:
        return None
    far = {0: shared(a, 0, b, 0)}
    if not goal and far[0] == n:
        return 0
    for edits in range(1, most + 1):
        new, left = {}, most - edits
        for k in range(max(-edits, goal - left), min(edits, goal + left) + 1):
            i = min(max(far.get(k - 1, -2) + 1, far.get(k, -2) + 1, far.get(k + 1, -2)), n, m + k)
            if i < 0 or i < k:
                continue
            i += shared(a, i, b, i - k)
            if k == goal and i == n:
                return edits
            new[k] = i
        far = new
    return None


def by_bits(a: str, b: str) -> int:
    """The distance, by columns of the table as bits of whole numbers (Myers; Hyyrö)."""
    whole, places = (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down = whole, 0  # places at which a column rises and falls
    for c in b:
        x = places.get(c, 0) | down
        same = (((x & up) + up) ^ up | x) & whole
        right, back = (down | whole ^ (same | up)) << 1 | 1, (up & same) << 1
        up, down = (back | whole ^ (same | right) & whole) & whole, right & same
    return len(b) + up.bit_count() - down.bit_count()


def distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, exact; where it is over `most`, any number over it.

    A string that the other one holds needs no table. As many edits are tried by diagonals as take time by the length.
    """
    if len(a) < len(b):
        a, b = b, a
    if b in a or (most is not None and len(a) - len(b) > most):
        return len(a) - len(b)
    begin = shared(a, 0, b, 0)
    a, b = a[begin:], b[begin:]
    if end := shared(a[::-1], 0, b[::-1], 0):
        a, b = a[:-end], b[:-end]
    if not b:
        return len(a)
    tried = isqrt(len(b))
    found = by_diagonals(a, b, tried if most is None else min(tried, most))
    if found is None:
        found = most + 1 if most is not None and most <= tried else by_bits(b, a)
    return found
