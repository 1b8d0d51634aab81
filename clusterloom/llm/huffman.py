"""Canonical length-limited Huffman codes over ids, with numpy encoding and table-driven decoding."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: longest code in bits; raised where more ids than 2^16 occur
LIMIT = 16
#: ids between two bit-offset checkpoints
EVERY = 256


class Code(NamedTuple):
    """Code words and lengths by id, and for each window of `limit` bits the id and length it starts with."""

    limit: int
    words: np.ndarray
    lengths: np.ndarray
    table_ids: np.ndarray
    table_lengths: np.ndarray


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for positive counts, by package-merge.

    Level by level, leaves and pairs of the level before are put in order of weight.  Of the last level
    the first 2n - 2 are taken, and a taken pair takes its two members one level down; a symbol's
    length is the number of levels at which its leaf is taken.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit into codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    row, flags = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        row = both[place]
        flags.append(place < n)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for flag in reversed(flags):
        own = int(flag[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> Code:
    """The canonical code of the lengths: in order of (length, id) each word is the one before plus one."""
    limit = max(int(lengths.max()), 1) if len(lengths) else 1
    order = np.lexsort((ids, lengths))
    steps = np.int64(1) << (limit - lengths[order])
    left = np.cumsum(steps) - steps  # words aligned to the left of `limit` bits
    size = int(ids.max()) + 1 if len(ids) else 1
    words, by_id = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
    words[ids[order]] = (left >> (limit - lengths[order])).astype(np.uint64)
    by_id[ids[order]] = lengths[order]
    table_ids, table_lengths = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    used = int(steps.sum())
    table_ids[:used] = np.repeat(ids[order], steps)
    table_lengths[:used] = np.repeat(lengths[order], steps)
    return Code(limit, words, by_id, table_ids, table_lengths)


def build(ids: np.ndarray, counts: np.ndarray, limit: int = LIMIT) -> Code:
    limit = max(limit, int(np.ceil(np.log2(max(2, len(ids))))))
    return canonical(ids, code_lengths(counts, limit))


def encode(code: Code, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all documents, the byte at which each starts (and the end), and the checkpoints' bit offsets.

    `sizes` are the documents' numbers of ids.  A document starts on a byte and stands alone; it has a
    checkpoint, counted from its start, at every EVERY-th id.
    """
    lengths = code.lengths[ids].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(lengths)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    bits = upto[first[1:]] - upto[first[:-1]]
    starts = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    at = upto[:-1] + np.repeat(starts[:-1] * 8 - upto[first[:-1]], sizes)
    cell, shift = at >> 6, 64 - (at & 63) - lengths
    words = code.words[ids]
    out = np.zeros((int(starts[-1]) + 7) // 8 + 1, np.uint64)
    if len(ids):
        whole = np.where(shift >= 0, words << np.maximum(shift, 0).astype(np.uint64), words >> np.maximum(-shift, 0).astype(np.uint64))
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out[cell[edge]] = np.bitwise_or.reduceat(whole, edge)
        over = np.flatnonzero(shift < 0)
        out[cell[over] + 1] |= words[over] << (64 + shift[over]).astype(np.uint64)
    inside = np.arange(len(ids)) - np.repeat(first[:-1], sizes)
    marks = np.flatnonzero(inside % EVERY == 0)
    checkpoints = at[marks] - np.repeat(starts[:-1] * 8, (sizes + EVERY - 1) // EVERY)
    return out.byteswap().view(np.uint8)[: int(starts[-1])], starts, checkpoints.astype(np.uint64)


def decode(code: Code, data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of all lanes: lane k holds sizes[k] ids from bit offsets[k] on.

    All lanes advance together, an id each per step, longest lanes first, so a step is a few numpy
    operations on the lanes still open: read a window of bits, look up its id and length, move on.
    """
    total = int(sizes.sum())
    out = np.empty(total, np.uint32)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    order = np.argsort(-sizes, kind="stable")
    bit, to = offsets[order].astype(np.int64), (np.cumsum(sizes) - sizes)[order]
    ordered = sizes[order]
    open_lanes = np.searchsorted(-ordered, -np.arange(int(ordered[0]) if len(ordered) else 0), side="left")
    view = np.lib.stride_tricks.sliding_window_view(padded, 4) if total else None
    mask, most = np.uint32((1 << code.limit) - 1), 32 - code.limit
    for step, n in enumerate(open_lanes.tolist()):
        here = bit[:n]
        window = np.ascontiguousarray(view[here >> 3]).view(">u4").reshape(-1).astype(np.uint32)
        window = (window >> (most - (here & 7)).astype(np.uint32)) & mask
        out[to[:n] + step] = code.table_ids[window]
        bit[:n] = here + code.table_lengths[window]
    return out
