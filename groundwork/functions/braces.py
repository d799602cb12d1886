"""Block structure of brace languages: which characters are code, how deep they are, where blocks end.

A small automaton knows strings, escapes and comments. It has so few states that a piece of text is a map
from the state before it to the state after it; the maps of all pieces of a batch of files are found
side by side and composed by a parallel prefix scan, so no character waits for the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

CODE, SLASH, LINE, BLOCK, STAR, DOUBLE, DOUBLE_ESC, SINGLE, SINGLE_ESC, TICK, TICK_ESC = range(11)
OTHER, SOLIDUS, ASTERISK, QUOTE, APOSTROPHE, GRAVE, BACKSLASH, NEWLINE, END = range(9)
STATES, PIECE = 11, 64


def _after(state: int, c: int) -> int:
    if c == END:
        return CODE
    if state in (CODE, SLASH):
        if state == SLASH and c in (SOLIDUS, ASTERISK):
            return LINE if c == SOLIDUS else BLOCK
        return {SOLIDUS: SLASH, QUOTE: DOUBLE, APOSTROPHE: SINGLE, GRAVE: TICK}.get(c, CODE)
    if state == LINE:
        return CODE if c == NEWLINE else LINE
    if state in (BLOCK, STAR):
        return STAR if c == ASTERISK else CODE if state == STAR and c == SOLIDUS else BLOCK
    if state in (DOUBLE_ESC, SINGLE_ESC, TICK_ESC):
        return CODE if c == NEWLINE and state != TICK_ESC else state - 1
    close = {DOUBLE: QUOTE, SINGLE: APOSTROPHE, TICK: GRAVE}[state]
    if c == close or (c == NEWLINE and state != TICK):  # only template strings go on in the next line
        return CODE
    return state + 1 if c == BACKSLASH else state


NEXT = np.array([[_after(s, c) for c in range(9)] for s in range(STATES)], np.uint8)
_CLASS = np.zeros(256, np.uint8)
for _c, _k in (("/", SOLIDUS), ("*", ASTERISK), ('"', QUOTE), ("'", APOSTROPHE), ("`", GRAVE), ("\\", BACKSLASH), ("\n", NEWLINE), ("\0", END)):
    _CLASS[ord(_c)] = _k


def states(data: np.ndarray) -> np.ndarray:
    """The automaton's state before every byte; a zero byte starts anew."""
    n = -(-len(data) // PIECE) * PIECE
    classes = np.full(n, END, np.uint8)
    classes[: len(data)] = _CLASS[data]
    rows = np.ascontiguousarray(classes.reshape(-1, PIECE).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows.shape[1], axis=1)
    for row in rows:
        maps = NEXT[maps, row]
    step = 1
    while step < maps.shape[1]:
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
        step *= 2
    state = np.r_[np.uint8(CODE), maps[CODE, :-1]] if maps.shape[1] else np.zeros(0, np.uint8)
    out = np.empty_like(rows)
    for k, row in enumerate(rows):
        out[k] = state
        state = NEXT[state, row]
    return out.T.reshape(-1)[: len(data)]


class Blocks:
    """Lines of one file with the depth at their starts and the ends of the blocks that open in them."""

    def __init__(self, lines: list[str], line_depth: np.ndarray, opens: dict[int, list[int]], ended: np.ndarray) -> None:
        self.lines, self.depth, self._opens, self._ended = lines, line_depth.tolist(), opens, ended.tolist()

    def end(self, line: int, within: int = 3) -> int:
        """Last line of the block that opens at ``line`` or in the lines right after it; ``line`` if none does before a statement ends."""
        for i in range(line, min(line + within, len(self.lines))):
            if i in self._opens:
                return max(self._opens[i])
            if self._ended[i]:
                return line
        return line


def blocks(texts: Sequence[str]) -> list[Blocks]:
    """Block structure of files; an unclosed block runs to the last line."""
    clean = [t.replace("\0", " ").replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    raw = "\0".join([*clean, ""]).encode("ascii", "replace")  # one byte a character
    data = np.frombuffer(raw, np.uint8)
    state = states(data)
    code = (state == CODE) | (state == SLASH)
    out, start = [], 0
    for text in clean:
        part, live = data[start : start + len(text)], code[start : start + len(text)]
        start += len(text) + 1
        lines = text.split("\n")
        if lines[-1] == "":
            lines.pop()
        breaks = np.flatnonzero(part == 10)
        move = np.where(live, (part == ord("{")).astype(np.int64) - (part == ord("}")), 0)
        run = np.cumsum(move)
        depth = run - np.minimum(0, np.minimum.accumulate(run)) if len(run) else run  # a stray closing brace stays at the top
        starts = np.r_[0, breaks + 1][: len(lines)]
        line_depth = np.where(starts > 0, depth[np.maximum(starts - 1, 0)], 0) if len(part) else np.zeros(len(lines), np.int64)
        at = np.flatnonzero(move)
        line_of = np.searchsorted(breaks, at)
        opens: dict[int, list[int]] = {}
        stack: list[tuple[int, int]] = []
        for kind, line in zip(move[at].tolist(), line_of.tolist(), strict=True):
            if kind > 0:
                opens.setdefault(line, []).append(len(lines) - 1)
                stack.append((line, len(opens[line]) - 1))
            elif stack:
                opened, k = stack.pop()
                opens[opened][k] = line
        # whether the last code character of a line ends a statement
        shown = np.flatnonzero(live & (part > 32) & ~((state[start - len(text) - 1 : start - 1] == SLASH) & ((part == ord("/")) | (part == ord("*")))))
        last = np.full(len(lines), -1)
        where = np.searchsorted(breaks, shown)
        last[where[where < len(lines)]] = shown[where < len(lines)]
        ended = (last >= 0) & (part[np.maximum(last, 0)] == ord(";")) if len(part) else np.zeros(len(lines), bool)
        out.append(Blocks(lines, line_depth, opens, ended))
    return out
