"""Counting many needles in one pass over a text (used inside Arrow batches)."""

from __future__ import annotations

import ahocorasick


def automaton(words) -> "ahocorasick.Automaton | None":
    machine = ahocorasick.Automaton()
    for word in words:
        if word:
            machine.add_word(word, word)
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def occurrences(machine, text: str) -> dict[str, int]:
    """Non-overlapping occurrences (leftmost first) of every needle that occurs in ``text``."""
    counts: dict[str, int] = {}
    free: dict[str, int] = {}
    for end, word in machine.iter(text):
        if end - len(word) + 1 >= free.get(word, 0):
            free[word] = end + 1
            counts[word] = counts.get(word, 0) + 1
    return counts
