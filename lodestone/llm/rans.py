"""Static range asymmetric numeral system over interleaved lanes, in numpy.

A block holds up to BLOCK symbols in LANES lanes; lane k takes the symbols k, k + LANES, ... Each lane keeps a 32-bit
state and renormalises by 16-bit words, all lanes of a row at once. Blocks depend on nothing but the segment's frequency
table, so each can be decoded alone. A segment of more distinct ids than the table holds is coded by digits: each id as two
symbols, its high part and its DIGIT low bits.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES, BLOCK, BITS, DIGIT = 1024, 1 << 17, 16, 12
TOTAL = 1 << BITS


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**16, in proportion to counts."""
    if len(counts) > TOTAL:
        raise ValueError(f"{len(counts)} distinct ids in a segment; the frequency table holds {TOTAL}")
    freq = np.maximum(1, counts * TOTAL // counts.sum()).astype(np.int64)
    rest = TOTAL - int(freq.sum())
    if rest > 0:
        freq[np.argmax(counts)] += rest
    while rest < 0:  # too many rare ids were raised to 1: take from the frequent ones
        order = np.argsort(-freq, kind="stable")
        spare = np.minimum(freq[order] - 1, np.maximum(1, freq[order] // 4))
        take = np.minimum(spare, np.maximum(0, -rest - np.concatenate(([0], np.cumsum(spare)[:-1]))))
        freq[order] -= take
        rest += int(take.sum())
    return freq.astype(np.uint64)


def encode_block(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """symbols: indexes into the table. Returns states, then 16-bit words in reading order."""
    state = np.full(LANES, TOTAL, np.uint64)
    words = []
    for at in range((len(symbols) - 1) // LANES * LANES, -1, -LANES):
        row = symbols[at : at + LANES]
        x, f = state[: len(row)], freq[row]
        full = x >= f << np.uint64(16)
        words.append((x[full] & np.uint64(0xFFFF)).astype("<u2"))
        x = np.where(full, x >> np.uint64(16), x)
        q = x // f
        state[: len(row)] = (q << np.uint64(BITS)) + (x - q * f) + start[row]
    return state.astype("<u4").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, freq: np.ndarray, start: np.ndarray, slot: np.ndarray) -> np.ndarray:
    state = np.frombuffer(data, "<u4", LANES).astype(np.uint64)
    words = np.frombuffer(data, "<u2", offset=4 * LANES).astype(np.uint64)
    out, read = np.empty(n, np.int64), 0
    for at in range(0, n, LANES):
        x = state[: min(LANES, n - at)]
        low = x & np.uint64(TOTAL - 1)
        row = slot[low]
        out[at : at + len(row)] = row
        x = freq[row] * (x >> np.uint64(BITS)) + low - start[row]
        short = x < TOTAL
        k = int(short.sum())
        x[short] = (x[short] << np.uint64(16)) | words[read : read + k]
        read += k
        state[: len(row)] = x
    return out


def pack_segment(ids: np.ndarray) -> tuple[bytes, list[dict]]:
    """The shared table (whether by digits, then id and frequency pairs), and the blocks: n ids, bytes, crc32, first id's place."""
    counts = np.bincount(ids)
    each = 1
    if np.count_nonzero(counts) > TOTAL:
        each, high = 2, ids >> DIGIT
        ids = np.stack([high + (1 << DIGIT), ids & ((1 << DIGIT) - 1)], 1).ravel()
        counts = np.bincount(ids)
    values = np.flatnonzero(counts)
    index, counts = (np.cumsum(counts > 0) - 1)[ids], counts[values]
    freq = quantise(counts)
    start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    blocks = []
    for at in range(0, len(ids), BLOCK):
        part = index[at : at + BLOCK]
        data = encode_block(part, freq, start)
        blocks.append({"at": at // each, "n": len(part) // each, "crc": zlib.crc32(data), "data": data})
    return np.concatenate(([each], values, freq)).astype("<u4").tobytes(), blocks


def unpack_segment(table: bytes, blocks: list[dict]) -> np.ndarray:
    """The ids; raises where a block's checksum doesn't hold."""
    head = np.frombuffer(table, "<u4")
    each, (values, freq) = int(head[0]), head[1:].reshape(2, -1)
    freq = freq.astype(np.uint64)
    start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    slot = np.repeat(np.arange(len(values)), freq.astype(np.int64))
    parts = []
    for b in blocks:
        if zlib.crc32(b["data"]) != b["crc"]:
            raise ValueError(f"block at token {b['at']}: checksum mismatch")
        part = values[decode_block(bytes(b["data"]), b["n"] * each, freq, start, slot)]
        parts.append(part if each == 1 else (part[::2] - np.uint32(1 << DIGIT) << np.uint32(DIGIT)) | part[1::2])
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)
