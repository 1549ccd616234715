"""Suffix arrays of a block of bytes by two-stage sorting, and the common prefixes of neighbours in them.

A suffix that is smaller than its successor (the one that starts a byte later) is of type S, else of type L. Only those of
type S are sorted directly, by their first `depth` bytes. A suffix of type L is found in a scan of the buckets (a bucket: the suffixes with one
first byte) in order: when a suffix is met in its place, the one that starts a byte before it, if it is of type L, takes the next
place in the bucket of its first byte, which is a later one or, in a run of one byte, the same. Suffixes of type L come before
those of type S in a bucket. Order beyond the first `depth` bytes is left open.
"""

from __future__ import annotations

import numpy as np

#: Rows of bytes compared at a time.
_ROWS = 8192


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """Per position whether its suffix is smaller than the next one; the end is smaller than any byte."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(t.astype(np.int16)))
    if n:
        step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    change = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal bytes ends
    return step[change] > 0


def needed_suffixes(wanted: np.ndarray, s_type: np.ndarray) -> np.ndarray:
    """The wanted positions and those from which wanted ones are induced: after one of type L all up to the next of type S."""
    n = len(wanted)
    next_s = np.minimum.accumulate(np.where(s_type, np.arange(n), n)[::-1])[::-1]
    lead = np.flatnonzero(wanted & ~s_type)
    change = np.zeros(n + 2, np.int64)
    np.add.at(change, lead, 1)
    np.add.at(change, next_s[lead] + 1, -1)
    return wanted | (np.cumsum(change)[:n] > 0)


def suffix_array(t: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The wanted positions of t (bytes; all, if None) in the order of the first `depth` bytes of their suffixes."""
    n = len(t)
    wanted = np.ones(n, bool) if wanted is None else wanted
    s_type = smaller_than_successor(t)
    need = needed_suffixes(wanted, s_type)
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    s = np.flatnonzero(need & s_type)
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    keys = np.ascontiguousarray(rows[s]).view(f"S{depth}").ravel()
    s = s[np.argsort(keys, kind="stable")]
    del keys
    first = np.searchsorted(t[s], np.arange(257))  # where each bucket's S suffixes begin
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(positions: np.ndarray, byte: int) -> None:
        before = positions[positions > 0] - 1
        before = before[need[before] & (t[before] > byte)]
        if len(before):
            order = np.argsort(t[before], kind="stable")
            before = before[order]
            bytes_ = t[before]
            cuts = np.flatnonzero(np.diff(bytes_)) + 1
            for part in np.split(before, cuts):
                waiting[t[part[0]]].append(part)

    hand_on(np.array([n]), -1)  # the end comes first of all
    out = []
    for c in range(256):
        own = waiting[c]
        if own:
            generation = np.concatenate(own)
            own = [generation]
            while len(generation):  # a run of one byte
                before = generation[generation > 0] - 1
                generation = before[need[before] & (t[before] == c)]
                own.append(generation)
        bucket = np.concatenate([*own, s[first[c] : first[c + 1]]])
        if len(bucket):
            hand_on(bucket, c)
            out.append(bucket)
        waiting[c] = []
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Per place of the order but the first, how many leading bytes its suffix shares with that before, `depth` at most."""
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    room = len(t) - np.maximum(order[1:], order[:-1])
    out = np.empty(max(0, len(order) - 1), np.int64)
    for lo in range(0, len(out), _ROWS):
        a, b = order[lo : lo + _ROWS + 1][:-1], order[lo + 1 : lo + _ROWS + 1]
        differ = rows[a[: len(b)]] != rows[b]
        some = differ.any(axis=1)
        out[lo : lo + len(b)] = np.where(some, differ.argmax(axis=1), depth)
    return np.minimum(out, room)
