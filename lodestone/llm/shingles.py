"""Shingle sets of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, and of all words in order the starts, lengths and 64-bit hashes; how many words each text has. Texts: lower-cased."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[data]
    start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    if not len(start):
        return data, start, start, np.empty(0, np.uint64), counts
    stop = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    length = stop - start
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(length.max()), _BASE, np.uint64))))
    inside = data[~blank]  # the words' bytes alone
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, length)
    return data, start, length, mix(np.add.reduceat(_BYTE[inside] * power[place], first) + length.astype(np.uint64)), counts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and how many words each text has. Texts: lower-cased."""
    return word_spans(texts)[3:]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted: of five words, or the whole sequence where there are fewer words."""
    words, counts = word_hashes([t.lower() for t in texts])
    if len(words) >= WIDTH:
        five = mix(sum(words[k : len(words) - WIDTH + 1 + k] * _PLACE[k] for k in range(WIDTH)))
    else:
        five = np.empty(0, np.uint64)
    out, at = [], 0
    for n in counts.tolist():
        if n >= WIDTH:
            s = np.sort(five[at : at + n - WIDTH + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(mix((words[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out
