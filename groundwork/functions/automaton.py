"""Many terms searched at once: an Aho-Corasick automaton in flat arrays, stepped over all pieces of a batch together.

Works on UTF-8 bytes; since no character's bytes occur inside another's, a term's bytes occur where the term does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes of text between two starts of a piece, at least; recorded hits between two reductions.
PIECE, HITS = 512, 1_000_000


@dataclass
class Automaton:
    """State 0 is the root. ``step[state * n_classes + class]`` is the next state; bytes that no term holds are class 0."""

    classes: np.ndarray
    n_classes: int
    step: np.ndarray
    term: np.ndarray  # the term that ends in a state, or -1
    first: np.ndarray  # the state itself or its longest suffix in which a term ends, or 0
    shorter: np.ndarray  # the same among proper suffixes
    longest: int


def build(terms: Sequence[bytes]) -> Automaton:
    """Automaton of distinct, non-empty ``terms``; a term's number is its position. Built depth by depth."""
    size = np.array([len(t) for t in terms], dtype=np.int64)
    data = np.frombuffer(b"".join(terms), dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    classes = np.zeros(256, dtype=np.uint8 if len(np.unique(data)) < 256 else np.uint16)
    used = np.unique(data)
    classes[used] = np.arange(1, len(used) + 1)
    k = len(used) + 1
    most = 1 + len(data)
    step, term = np.zeros((most, k), dtype=np.int32), np.full(most, -1, dtype=np.int32)
    back, first, shorter = (np.zeros(most, dtype=np.int32) for _ in range(3))
    at, n = np.zeros(len(terms), dtype=np.int64), 1
    for depth in range(int(size.max())):
        going = np.flatnonzero(size > depth)
        edge, which = np.unique(at[going] * k + classes[data[start[going] + depth]], return_inverse=True)
        parent, label, child = edge // k, edge % k, n + np.arange(len(edge))
        at[going] = child[which]
        ending = going[size[going] == depth + 1]
        term[at[ending]] = ending
        if depth:
            back[child] = step[back[parent], label]
        step[parent, label] = child
        step[child] = step[back[child]]  # children of the next depth overwrite their own
        shorter[child] = first[back[child]]
        first[child] = np.where(term[child] >= 0, child, shorter[child])
        n += len(edge)
    return Automaton(classes, k, step[:n].reshape(-1), term[:n], first[:n], shorter[:n], int(size.max()))


def find(a: Automaton, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs of the texts ``data[start[row]:stop[row]]``, sorted.

    Texts are cut into pieces that begin a term's length early, so memory and steps do not depend on the longest text.
    """
    stride = max(PIECE, 4 * a.longest)
    n = -(-(stop - start) // stride)
    row = np.repeat(np.arange(len(start)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    end = np.minimum(start[row] + (nth + 1) * stride, stop[row])
    begin = np.maximum(start[row] + nth * stride - (a.longest - 1), start[row])
    order = np.argsort(begin - end, kind="stable")
    row, begin, length = row[order], begin[order], (end - begin)[order]
    codes = a.classes[data]
    states = len(a.term)
    alive = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    state, found, held = np.zeros(len(row), dtype=np.int64), [], 0
    for t, m in enumerate(alive):
        state = a.step[state[:m].astype(np.int64) * a.n_classes + codes[begin[:m] + t]]
        ends = a.first[state]
        hit = np.flatnonzero(ends)
        if len(hit):
            found.append(row[hit] * states + ends[hit])
            held += len(hit)
            if held > HITS:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    rows, at, pairs = key // states, key % states, []
    while len(at):
        pairs.append(rows * states + a.term[at])
        at = a.shorter[at]
        rows, at = rows[at > 0], at[at > 0]
    key = np.unique(np.concatenate(pairs)) if pairs else key
    return key // states, key % states
