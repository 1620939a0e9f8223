"""Distances of words in slips: insertions, deletions, substitutions and neighbour swaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deletions_of(word: str) -> set[str]:
    """The word with no or one letter deleted; any two words one slip apart have one of these in common."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def one_slip(a: Column, b: Column) -> Column:
    """Whether a and b are equal or one insertion, deletion, substitution or neighbour swap apart."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.levenshtein(a, b, 1).between(0, 1) | swapped


def slips(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and neighbour swaps between a and b; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b or max(len(a), len(b)) == 1:
        return min(max(len(a), len(b)), most + 1)
    if most == 1:
        return 1 if len(a) == len(b) == 2 and a == b[::-1] else 2
    before, row = [], list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, q in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (p != q))
            if i > 1 and j > 1 and p == b[j - 2] and a[i - 2] == q:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most and min(before) > most:
            return most + 1
    return min(row[-1], most + 1)
