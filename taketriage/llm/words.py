"""Words of many texts at once, as 64-bit hashes, on their UTF-8 bytes.

A word class that has either all or no bytes from 0x80 on can be told by
bytes; both classes used here have them all.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes looked at together; longer texts are cut at separators.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _class(separators: bytes) -> np.ndarray:
    lut = np.ones(256, bool)
    lut[list(separators)] = False
    return lut


#: Word bytes: anything but white space; digits, a-z and all beyond ASCII.
NOT_SPACE = _class(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = _class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = BLOCK + 2
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(inverse)
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_words(block: bytes, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a block of at most BLOCK bytes."""
    arr = np.frombuffer(block, np.uint8)
    inside = word[arr]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers()
    sums = np.zeros(len(arr) + 1, np.uint64)
    np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * up[: len(arr)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _word_hash(text: bytes) -> np.ndarray:
    """The hash of one word of any length, as a block that held it would give."""
    up, total, scale = _powers()[0], 0, 1
    for i in range(0, len(text), BLOCK):
        arr = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - i), i).astype(np.uint64) + np.uint64(1)
        total += scale * int((arr * up[: len(arr)]).sum())
        scale = scale * pow(_BASE, BLOCK, 1 << 64) & _MASK
    return mixed(np.array([(total + len(text)) & _MASK], np.uint64))


def _long_words(text: bytes, word: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text of any length, words of any length too."""
    out, at = [np.zeros(0, np.uint64)], 0
    inside = lambda a: word[np.frombuffer(text, np.uint8, min(BLOCK, len(text) - a), a)]
    while at < len(text):
        here = inside(at)
        end = at + len(here)
        if end < len(text) and here.all():  # one word, longer than a block or as long
            while end < len(text):
                here = inside(end)
                end += len(here) if here.all() else int(np.argmin(here))
                if not here.all():
                    break
            out.append(_word_hash(text[at:end]))
        else:
            if end < len(text):
                end = at + int(np.flatnonzero(~here)[-1]) + 1
            out.append(_block_words(text[at:end], word)[0])
        at = end
    return np.concatenate(out)


def word_hashes(texts: list[bytes | None], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one more at the end).

    A-Z count as a-z.
    """
    out: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    block: list[bytes] = []
    rows: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if rows:
            hashes, starts = _block_words(b" ".join(block), word)
            lengths = np.array([len(b) + 1 for b in block])
            edges = np.concatenate([[0], np.cumsum(lengths)])
            counts[rows] = np.diff(np.searchsorted(starts, edges))
            out.append(hashes)
        block.clear(), rows.clear()
        size = 0

    with np.errstate(over="ignore"):
        for i, t in enumerate(texts):
            t = (t or b"").lower()
            if size + len(t) + 1 > BLOCK:
                flush()
            if len(t) + 1 > BLOCK:
                hashes = _long_words(t, word)
                counts[i] = len(hashes)
                out.append(hashes)
                continue
            block.append(t)
            rows.append(i)
            size += len(t) + 1
        flush()
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([[0], np.cumsum(counts)])


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words; of all of them, if fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n_eff = min(n, len(words))
    with np.errstate(over="ignore"):
        acc = np.full(len(words) - n_eff + 1, np.uint64(n_eff), np.uint64)
        for k in range(n_eff):
            acc = mixed(acc * np.uint64(_BASE) + words[k : len(words) - n_eff + 1 + k])
    return np.unique(acc)


def suffix_automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """By state: transitions, suffix link (-1 at the root), length of its
    longest string, and where that first ends."""
    nexts: list[dict[int, int]] = [{}]
    link, length, first, last = [-1], [0], [-1], 0
    for at, c in enumerate(symbols):
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        first.append(at)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts, link, length, first
