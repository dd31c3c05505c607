"""Which runs of capitalised words are names of persons, learnt from the collection.

Given names of a list and forms of address mark some runs as names; all other runs of the same sample are taken for
something else. A logistic model learns from the words and marks around the runs and from their shape, not from who is named,
so that it also knows a name that is in no list. Every example is seen twice, once without its inner features: then
only its surroundings speak.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np

#: Weights of the model (features are hashed): its size, whatever the collection.
SIZE = 1 << 18
#: Most examples the model is fitted on, and documents they are drawn from on average.
EXAMPLES, SAMPLE_DOCUMENTS = 60_000, 6_000
#: A run is a name from this probability on.
LEAST = 0.4

_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_SPAN, _NEAR = 80, 32


def _around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """The last words and marks before a place and the first after it, as many as the features use."""
    # Of four in a few characters the three nearest are whole: the usual case, which needs no more of the text.
    start = a
    before: list[str] = _WORD.findall(text, max(0, a - _NEAR), a)
    if len(before) < 4:
        before = []
    while start > 0 and len(before) < 3:
        start = max(0, start - _SPAN)
        before = _WORD.findall(text, start, a)
        if "\n" in text[start:a] and before:
            break
    stop = b
    after: list[str] = _WORD.findall(text, b, b + _NEAR)
    if len(after) < 4:
        after = []
    while stop < len(text) and len(after) < 3:
        stop = min(len(text), stop + _SPAN)
        after = _WORD.findall(text, b, stop)
    return before[-3:], after[:3]


def _code(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SIZE


def features(text: str, a: int, b: int) -> tuple[list[int], list[int]]:
    """Hashed features of the run ``text[a:b]``: of its surroundings, and of itself."""
    return _outer(*_surroundings(text, a, b)).tolist(), _inner(text[a:b]).tolist()


def _surroundings(text: str, a: int, b: int) -> tuple[tuple[str, ...], tuple[str, ...], bool]:
    before, after = _around(text, a, b)
    return tuple(["", "", "", *before][-3:]), tuple([*after, "", "", ""][:3]), a == 0 or text[a - 1] == "\n"


@functools.lru_cache(1 << 15)
def _outer(before: tuple[str, ...], after: tuple[str, ...], line: bool) -> np.ndarray:
    low_b, low_a = [w.lower() for w in before], [w.lower() for w in after]
    outer = [
        f"b1 {low_b[2]}", f"b2 {low_b[1]} {low_b[2]}", f"b3 {low_b[0]} {low_b[1]}", f"a1 {low_a[0]}", f"a2 {low_a[0]} {low_a[1]}", f"a3 {low_a[1]} {low_a[2]}", f"c {low_b[2]} {low_a[0]}",
        f"s1 {low_b[2][-3:]}", f"s2 {low_a[0][-3:]}", f"u {before[2][:1].isupper()} {after[0][:1].isupper()}", f"line {line}", "bias",
    ]
    return np.array(list(map(_code, outer)))


@functools.lru_cache(1 << 15)
def _inner(run: str) -> np.ndarray:
    words = run.split()
    inner = [f"n {len(words)}", f"p {any(w.islower() for w in words)}", f"l {words[-1].lower()[-3:]}", f"k {words[-1].lower()}", f"i {any(len(w.strip('.')) == 1 for w in words)}", f"t {run.isupper()}"]
    return np.array(list(map(_code, inner)))


def _fit(rows: np.ndarray, wanted: np.ndarray, counts: np.ndarray, steps: int, shrink: float) -> np.ndarray:
    held, moved = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-8)
    width, total = rows.shape[1], counts.sum()
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(held[rows].sum(1), -30, 30))) - wanted) * counts
        slope = np.bincount(rows.ravel(), np.repeat(error, width), SIZE + 1) / total + shrink * held
        moved += slope * slope
        held -= 0.5 * slope / np.sqrt(moved)
        held[SIZE] = 0
    return held


def fit(examples: list[tuple[bool, list[int], list[int]]], steps: int = 150, rounds: int = 3, shrink: float = 1e-6) -> np.ndarray:
    """Weights from examples ``(is a name, outer, inner)``; all zero where there aren't both kinds.

    Names that no list has stand among the other runs. So what a first model finds at least half as likely as the known names are
    on average isn't taken for something else by the next one.
    """
    weights = np.zeros(SIZE, np.float32)
    names = sum(e[0] for e in examples)
    if not 0 < names < len(examples):
        return weights
    width = max(len(o) + len(i) for _, o, i in examples)
    rows = np.full((2 * len(examples), width), SIZE, np.int64)
    for k, (_, outer, inner) in enumerate(examples):
        rows[2 * k, : len(outer) + len(inner)] = outer + inner
        rows[2 * k + 1, : len(outer)] = outer
    wanted = np.repeat(np.array([e[0] for e in examples], np.float64), 2)
    counts = np.ones(len(rows))
    for turn in range(rounds):
        held = _fit(rows, wanted, counts, steps, shrink)
        chance = 1 / (1 + np.exp(-np.clip(held[rows].sum(1), -30, 30)))
        # By their surroundings alone: who is named would tell the list's names from all others.
        likely = chance[1::2] >= chance[1::2][wanted[1::2] == 1].mean() / 2
        counts = np.where((wanted == 0) & np.repeat(likely, 2), 0.0, 1.0)
    return held[:SIZE].astype(np.float32)


def probability(weights: np.ndarray, text: str, a: int, b: int) -> float:
    """How sure the model is that a run is a name; 0 for a model that learnt nothing."""
    score = float(np.add.reduce(weights.take(_outer(*_surroundings(text, a, b)))) + np.add.reduce(weights.take(_inner(text[a:b]))))
    return 0.0 if score == 0 else 1 / (1 + np.exp(-score))
