"""Simple-8b with escapes: word-aligned coding of unsigned integers in numpy.

A 64-bit little-endian word has a selector in its top four bits and as many values of equal
width as the selector says. Selector 0 is an escape: the whole next word is one value of over
60 bits. Ids are coded in blocks of BLOCK values, each beginning on a word, so that blocks are
coded side by side and a reader can decode any block from its offset.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
#: Values a word holds, by selector 1..14; their width is 60 // count.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]


_LENGTHS = np.repeat(np.arange(17, dtype=np.uint8), [1] + [1 << i for i in range(16)])  # of 16-bit values


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    out = _LENGTHS[v.astype(np.uint16)]
    top = int(v.max())
    for shift in (16, 32, 48):
        if top >> shift:
            part = (v >> np.uint64(shift)).astype(np.uint16)
            np.copyto(out, _LENGTHS[part] + np.uint8(shift), where=part > 0)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and the word offset of each block (uint32)."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    bits = np.zeros(blocks * BLOCK, np.uint8)
    bits[:n] = _bit_lengths(v)
    bits = bits.reshape(blocks, BLOCK)
    last = n - (blocks - 1) * BLOCK  # values of the last block
    pick = np.zeros((blocks, BLOCK), np.uint8)  # the best selector for a word that begins at each value
    widest, most = {1: bits}, 1
    while most < max(COUNTS):  # the largest width in windows of 2, 4, 8, ... values
        widest[2 * most] = np.maximum(widest[most][:, :-most], widest[most][:, most:])
        most *= 2
        if most * 2 > max(COUNTS):
            break
    for s in range(len(COUNTS), 0, -1):
        count = COUNTS[s - 1]
        half = 1 << (count.bit_length() - 1)
        w = widest[half]
        stop = BLOCK - count + 1
        fits = np.maximum(w[:, :stop], w[:, count - half : count - half + stop]) <= 60 // count
        fits[-1, max(0, last - count + 1) :] = False
        pick[:, :stop][fits] = s
    pick = pick.reshape(-1)
    take = np.array([1, *COUNTS], np.int64)[pick]
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    block = np.arange(len(at))
    starts, owner = [], []
    while len(at):  # one word of every unfinished block a step
        starts.append(at)
        owner.append(block)
        at = at + take[at]
        keep = at < ends
        if not keep.all():
            at, ends, block = at[keep], ends[keep], block[keep]
    starts, owner = np.concatenate(starts), np.concatenate(owner)
    starts.sort()
    owner.sort()
    sel = pick[starts]
    size = np.where(sel == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        if s == 0:
            words[place[rows] + 1] = v[starts[rows]]
            continue
        count = COUNTS[s - 1]
        shift = (np.arange(count) * (60 // count)).astype(np.uint64)
        words[place[rows]] = np.bitwise_or.reduce(v[starts[rows][:, None] + np.arange(count)] << shift, axis=1) | np.uint64(s << 60)
    offsets = np.zeros(-(-n // BLOCK), np.int64)
    np.add.at(offsets, owner, size)
    return words, (np.cumsum(offsets) - offsets).astype(np.uint32)


def decode(words: np.ndarray) -> np.ndarray:
    """All values of words, which begin with a block."""
    w = np.ascontiguousarray(words, dtype=np.uint64)
    sel = (w >> np.uint64(60)).astype(np.uint8)
    head = np.ones(len(w), bool)
    for i in np.flatnonzero(sel == 0).tolist():  # an escape's second word is no head
        if head[i]:
            head[i + 1] = False
    count = np.where(head, np.array([1, *COUNTS, 0], np.int64)[sel], 0)
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(sel[head]).tolist():
        rows = np.flatnonzero(head & (sel == s))
        if s == 0:
            out[place[rows]] = w[rows + 1]
            continue
        c = COUNTS[s - 1]
        width = 60 // c
        shift = (np.arange(c) * width).astype(np.uint64)
        out[place[rows][:, None] + np.arange(c)] = (w[rows][:, None] >> shift) & np.uint64((1 << width) - 1)
    return out
