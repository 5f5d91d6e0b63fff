"""Matching of calls stored in pre-order with child counts, whole arrays at a time.

A call takes one child slot and opens as many as it has children.  Slots are a stack;
the slot a call takes lies at some level, counted from the slots open before the first
row, and the slots it opens lie from that level on.  So the parent of a call is the last
earlier call at its level or below, found by jumping along pointers whose reach doubles.
Depths, subtree ends and nearest calls of a kind follow from parents in the same way.

Rows of several blocks may stand in one array.  A block may begin with calls that are
still open from earlier blocks (``entries``, outermost first, with the slots they have
left); they take no slot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Blocks:
    """Rows of whole blocks: ``starts`` marks first rows, ``children`` is never negative."""

    starts: np.ndarray
    children: np.ndarray
    entries: np.ndarray
    level: np.ndarray

    @classmethod
    def of(cls, starts: np.ndarray, children: np.ndarray, entries: np.ndarray) -> Blocks:
        children = np.maximum(children, 0)
        change = children - ~entries
        before = np.cumsum(change) - change
        begin = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
        return cls(starts, children, entries, before - before[begin] - ~entries if len(starts) else before)

    def parents(self) -> np.ndarray:
        """The row of each call's parent, -1 for roots."""
        found = np.where(self.starts, -1, np.arange(len(self.level)) - 1)
        open_ = np.flatnonzero(found >= 0)
        while len(open_):
            open_ = open_[self.level[found[open_]] > self.level[open_]]
            found[open_] = found[found[open_]]
            open_ = open_[found[open_] >= 0]
        return found


def ends(parents: np.ndarray) -> np.ndarray:
    """The first row behind each call's subtree inside its block: behind its last child's, over and over."""
    last = np.arange(len(parents))
    inner = np.flatnonzero(parents >= 0)
    last[parents[inner]] = inner  # of rows with the same parent the last one stays
    while True:
        further = last[last]
        if (further == last).all():
            return last + 1
        last = further


def depths(parents: np.ndarray) -> np.ndarray:
    """How many calls are around each call."""
    found, jump = (parents >= 0).astype(np.int64), parents.copy()
    open_ = np.flatnonzero(jump >= 0)
    while len(open_):
        # both reads before both writes: every pointer jumps over what its target had covered so far
        more, far = found[jump[open_]], jump[jump[open_]]
        found[open_] += more
        jump[open_] = far
        open_ = open_[far >= 0]
    return found


def nearest(parents: np.ndarray, passed_over: np.ndarray) -> np.ndarray:
    """The row of the nearest call around each one that is not ``passed_over``, -1 if there is none."""
    found = parents.copy()
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        open_ = open_[passed_over[found[open_]]]
        found[open_] = found[found[open_]]
        open_ = open_[found[open_] >= 0]
    return found


def chains(rows: np.ndarray, parents: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The calls around each of ``rows`` and the row itself, outermost first: all of them end to end, and where each list begins."""
    begins = np.concatenate([[0], np.cumsum(depth[rows] + 1)])
    out = np.empty(begins[-1], np.int64)
    place, at = begins[1:] - 1, rows
    while len(at):
        out[place] = at
        more = parents[at] >= 0
        place, at = place[more] - 1, parents[at[more]]
    return out, begins


def taken_and_open(blocks: Blocks) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For blocks without entries: slots each takes of calls around it, the rows it leaves open, and slots left by row."""
    if not len(blocks.level):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    begins = np.flatnonzero(blocks.starts)
    taken = np.maximum(-np.minimum.reduceat(blocks.level, begins), 0)
    parents = blocks.parents()
    left = blocks.children - np.bincount(parents[parents >= 0], minlength=len(parents))
    lasts = np.append(begins[1:], len(parents)) - 1
    rows, bounds = chains(lasts, parents, depths(parents))
    opened = []
    for k, last in enumerate(lasts):
        own = rows[bounds[k] : bounds[k + 1]]
        opened.append(own if blocks.children[last] else own[:-1])
    return taken, opened, left
