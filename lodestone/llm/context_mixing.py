"""Logistic context mixing over the binary decisions of a text's tokens, in numpy.

Tokens are lower-cased words and an end. The most frequent training words are the leaves of a Huffman tree, beside the end
and a leaf for all other words; these are spelt out, byte by byte and with a stop, under a second Huffman tree. So a text is
a chain of binary decisions, each at a node of a tree.

PREDICTORS hashed contexts tell each decision's odds: those of words from the words before (one, two, three, the last two
of the OFTEN most frequent ones, which tell the language), those of bytes from the bytes before (two to four, and two or
three with the last frequent word); the last predictor of words is a match model that adapts to the text: what followed when
the last two words occurred in it before. The log-odds are combined by weights that a gate selects (how well two of the
contexts are known, whether there is a match). All is learned online, in one pass: every batch of decisions is first
predicted with what was counted before, to correct the weights, and then counted. A last stage refines the probability by a
table over the place in the code and the probability's own interval.

Texts longer than PIECE bytes are walked in pieces that end at a blank; contexts begin anew in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lodestone.llm.shingles import word_spans

#: Leading bits of the slots of each context.
BITS = (20, 21, 21, 20, 20)
PREDICTORS = len(BITS)
FIRST = np.concatenate(([0], np.cumsum([1 << b for b in BITS])))
SLOTS, PAGE = int(FIRST[-1]), 1 << 12
KNOWN, GATES, LEVELS, PLACES, PRIOR, RATE, STEPS = 6, 72, 33, 40, 0.4, 0.15, 64
#: Bytes of a piece, bytes of texts that are taken together, decisions of a batch.
PIECE, TOGETHER, BATCH = 1 << 20, 1 << 18, 1 << 14
OFTEN, STOP = 12, 256
_C1, _C2, _C3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_ONE, _START, _END = np.uint32(1), np.uint32(0x1B873593), np.uint32(0xCC9E2D51)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code, at most 30."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.uint8)
    order = np.argsort(counts, kind="stable")
    weight, parent = [*counts[order].tolist()], [0] * (2 * n - 1)
    leaf, inner = 0, n
    for at in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (inner >= at or weight[leaf] <= weight[inner]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, inner = inner, inner + 1
            total += weight[pick]
            parent[pick] = at
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for at in range(2 * n - 3, -1, -1):
        depth[at] = depth[parent[at]] + 1
    if max(depth[:n]) > 30:
        return code_lengths(counts // 2 + 1)
    out = np.empty(n, np.uint8)
    out[order] = depth[:n]
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code words of a canonical code, in the order of the symbols among those of a length."""
    order = np.argsort(lengths, kind="stable")
    out, code, before = np.empty(len(lengths), np.uint32), 0, 0
    each = np.bincount(lengths)
    at = 0
    for length, n in enumerate(each.tolist()):
        code <<= 1
        out[order[at : at + n]] = np.arange(code, code + n)
        code, at = code + n, at + n
    return out


class Code:
    """The two trees. words: the dictionary in the order of bytes; hashes: theirs; ends: documents; rest: tokens outside."""

    def __init__(self, words: list[bytes], hashes: np.ndarray, counts: np.ndarray, ends: int, rest: int):
        every = np.concatenate((counts.astype(np.int64), [ends + 1, rest + 1]))
        lengths = code_lengths(every)
        codes = canonical(lengths)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.lengths, self.codes = np.append(lengths[:-2][order], lengths[-2:]), np.append(codes[:-2][order], codes[-2:])
        often = np.zeros(len(every), bool)
        often[np.argsort(-counts, kind="stable")[:OFTEN]] = True
        self.often = np.append(often[:-2][order], [False, False])
        letters = np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=257) + 1
        letters[STOP] = len(words) + 1
        self.letter_lengths = code_lengths(letters)
        self.letter_codes = canonical(self.letter_lengths)

    def symbols(self, hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places in codes and lengths; the end is the last but one, words outside the last."""
        n = len(self.hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, n - 1))
        found = self.hashes[at] == hashes if n else np.zeros(len(hashes), bool)
        return np.where(end, n, np.where(found, at, n + 1))


def _hash(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), 0x2545F491, np.uint32)
    for p in parts:
        out = (out ^ p) * _C1
        out ^= out >> np.uint32(15)
    return out * _C3


def _shifted(x: np.ndarray, by: int, place: np.ndarray) -> np.ndarray:
    """x a few places before, _START before each beginning."""
    out = np.empty_like(x)
    out[:by] = _START
    out[by:] = x[:-by] if by else x
    out[place < by] = _START
    return out


def pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[bool]]]:
    """Pieces of texts, the texts that they are of, and whether the text ends there; about TOGETHER bytes at a time."""
    parts, owner, last, size = [], [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = at + PIECE
            while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            parts.append(text[at:end])
            owner.append(k)
            last.append(end >= len(text))
            size += len(parts[-1]) + 1
            if size >= TOGETHER:
                yield parts, owner, last
                parts, owner, last, size = [], [], [], 0
            at = end
            if at >= len(text):
                break
    if parts:
        yield parts, owner, last


class Tokens:
    """The tokens of pieces: hash (64 bits; an end's is 0), piece, place in the piece, symbol, owner."""

    def __init__(self, code: Code, parts: list[bytes], owner: list[int], last: list[bool]):
        data, start, length, hashes, counts = word_spans([p.lower() for p in parts])
        closed = np.array(last)
        self.counts = counts + closed
        at = np.cumsum(counts)[closed]
        self.hashes = np.insert(hashes, at, 0)
        end = np.zeros(len(hashes), bool)
        self.end = np.insert(end, at, True)
        self.owner = np.repeat(np.array(owner), self.counts)
        first = np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.place = np.arange(len(self.hashes)) - first
        self.first = first
        self.symbol = code.symbols(self.hashes, self.end)
        spelt = np.flatnonzero(self.symbol == len(code.hashes) + 1)
        self.spelt = spelt
        inside = np.flatnonzero(~self.end)
        span = np.searchsorted(inside, spelt)
        n = length[span] + 1
        self.letter_of = np.repeat(np.arange(len(spelt)), n)
        self.letter_place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        letters = data[np.minimum(start[span][self.letter_of] + self.letter_place, len(data) - 1)].astype(np.int64) if len(spelt) else np.empty(0, np.int64)
        letters[self.letter_place == n[self.letter_of] - 1] = STOP
        self.letters = letters


def _words_before(code: Code, t: Tokens) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A 32-bit hash of each context of each token; the token that the match model expects (-1: none) and its class."""
    own = np.where(t.end, _END, (t.hashes >> np.uint64(32)).astype(np.uint32))
    n = np.arange(len(own))
    one, two, three = (_shifted(own, k, t.place) for k in (1, 2, 3))
    seen = np.maximum.accumulate(np.where(code.often[t.symbol], n, -1))
    before = np.concatenate(([-1], seen[:-1]))
    last = np.where(before >= t.first, before, -1)
    last2 = np.where(last >= 0, before[last], -1)
    last2 = np.where(last2 >= t.first, last2, -1)
    often, often2 = np.where(last >= 0, own[last], _START), np.where(last2 >= 0, own[last2], _START)
    contexts = [_hash(one), _hash(one, two), _hash(one, two, three), _hash(often, often2)]
    # the match model: the same two words before, in the same piece
    key = _hash(one, two).astype(np.uint64) << np.uint64(32) | t.first.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[order][1:] == key[order][:-1])) & (t.place[order] >= 2)
    expected = np.full(len(own), -1)
    expected[order[1:][same[1:]]] = order[:-1][same[1:]]
    hit = (expected >= 0) & (own[expected] == own)
    miss = np.maximum.accumulate(np.where(hit, -1, n))
    run = np.concatenate(([0], (n - miss)[:-1]))
    kind = np.where(expected >= 0, 1 + np.minimum(run, 14), 0)
    return contexts, np.where(expected >= 0, t.symbol[expected], -1), kind, often


def _letters_before(t: Tokens, often: np.ndarray) -> list[np.ndarray]:
    x = (t.letters + 1).astype(np.uint32)
    one, two, three, four = (_shifted(x, k, t.letter_place) for k in (1, 2, 3, 4))
    language = often[t.spelt][t.letter_of]
    return [_hash(one, two), _hash(one, two, three), _hash(one, two, three, four), _hash(one, two, language), _hash(one, two, three, language)]


def _decisions(contexts: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray, expected: tuple[np.ndarray, ...] | None) -> Iterator[tuple]:
    """For each batch: the first and last symbol and how many decisions each has; slots by predictor, bit, place in the code, and whether a match foretells it.

    expected: by symbol the code word and length that the match model expects, and its class (0: none); None: the second tree.
    """
    ends = np.cumsum(lengths, dtype=np.int64)
    whole = lengths.astype(np.uint32)
    cuts = [0, *np.searchsorted(ends, np.arange(BATCH, int(ends[-1]), BATCH)).tolist(), len(lengths)] if len(ends) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        size = lengths[a:b].astype(np.int64)
        each = lambda x: np.repeat(x[a:b], size)  # noqa: B023, E731  an element for each decision
        first_of = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.uint32)
        place -= np.repeat(first_of.astype(np.uint32), size)
        code, rest = each(codes), each(whole)
        rest -= place
        above = code >> rest
        rest -= _ONE
        code >>= rest
        code &= _ONE
        bit = code.astype(np.int64)
        spread = _ONE << place
        spread |= above
        if expected is None:
            spread += np.uint32(1 << 31)
        spread *= _C2
        slots = []
        for c, bits, first in zip(contexts, BITS, FIRST, strict=False):
            own = each(c)
            own ^= spread
            own *= _C1
            own >>= np.uint32(32 - bits)
            slots.append(own.astype(np.int64))
            slots[-1] += first
        foretold = np.zeros(len(place), np.int64)
        if expected is not None:
            code2, length2, kind = (x[a:b] for x in expected)
            told = np.flatnonzero(kind)  # their decisions alone
            of = np.repeat(told, size[told])
            held = np.arange(len(of)) + np.repeat(first_of[told] - (np.cumsum(size[told]) - size[told]), size[told])
            rest2 = length2[of].astype(np.int64) - place[held]
            inside = rest2 > 0
            of, held, down = of[inside], held[inside], rest2[inside].astype(np.uint32)
            same = code2[of] >> down == above[held]
            of, held, down = of[same], held[same], down[same]
            foretold[held] = kind[of] * 2 + (code2[of] >> (down - _ONE) & _ONE)
            slots.append(foretold + FIRST[PREDICTORS - 1])
        yield (a, b, size), slots, bit, place, foretold > 0


def tokens(code: Code, texts: list[bytes]) -> Iterator[Tokens]:
    """The texts' tokens, a few texts at a time; owner says which text each is of."""
    for group in pieces(texts):
        yield Tokens(code, *group)


def walk(code: Code, t: Tokens) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, int]]:
    """Batches of decisions: text, slots by predictor, bit, place in the code, whether foretold, tree (0: words, 1: letters)."""
    contexts, expected, kind, often = _words_before(code, t)
    held = np.maximum(expected, 0)
    foretold = (code.codes[held], code.lengths[held], kind)
    for (a, b, size), *rest in _decisions(contexts, code.codes[t.symbol], code.lengths[t.symbol], foretold):
        yield np.repeat(t.owner[a:b], size), *rest, 0
    letter_owner = t.owner[t.spelt][t.letter_of]
    for (a, b, size), *rest in _decisions(_letters_before(t, often), code.letter_codes[t.letters], code.letter_lengths[t.letters], None):
        yield np.repeat(letter_owner[a:b], size), *rest, 1


def _classes(seen: np.ndarray) -> np.ndarray:
    """KNOWN classes of how often a context has been seen."""
    steps = np.zeros(seen.shape, np.int8)
    for x in (0.5, 2.5, 10, 60, 1000):
        steps += seen > x
    return steps


#: The classes of whole counts up to the last class's first.
_CLASS = _classes(np.arange(1002))


def _gate(known: np.ndarray, next_: np.ndarray, foretold: np.ndarray, tree: int) -> np.ndarray:
    """The set of weights: classes of how well the second and the third context are known, matches, tree. GATES fit the classes' small integers."""
    return (((known * 3 + np.minimum(next_, 2)) * 2 + foretold) * 2 + tree).astype(np.int64)


def _interval(mixed: np.ndarray, place: np.ndarray, tree: int) -> np.ndarray:
    """The cell of the last stage."""
    level = mixed * 2
    np.rint(level, out=level)
    np.maximum(level, -16, out=level)
    np.minimum(level, 16, out=level)
    out = level.astype(np.int64)
    out += np.minimum(place, np.uint32(PLACES // 2 - 1)) * np.uint32(2 * LEVELS)
    out += tree * LEVELS + 16
    return out


def _chance(mixed: np.ndarray) -> np.ndarray:
    out = np.maximum(-mixed, -20)
    np.minimum(out, 20, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _mixed(weights: np.ndarray, gate: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
    """The weighted sum of the odds; weights (PREDICTORS, GATES)."""
    return sum(w.take(gate, mode="clip") * x for w, x in zip(weights, odds, strict=True))


class Learner:
    """Mixing weights and the last stage's table, learned online from texts, whose decisions are added to table (SLOTS, 2)."""

    def __init__(self, table: np.ndarray):
        self.table = table.reshape(-1)
        self.weights = np.full((GATES, PREDICTORS), 0.25)
        self.squares = np.full((GATES, PREDICTORS), 1e-3)
        self.hits, self.total, self.mass = np.zeros(PLACES * LEVELS), np.zeros(PLACES * LEVELS), 0

    def learn(self, code: Code, texts: list[bytes]) -> None:
        ones = np.ones(2 * BATCH, self.table.dtype)
        for t in tokens(code, texts):
            for _, slots, bit, place, foretold, tree in walk(code, t):
                at = [s * 2 + bit for s in slots]
                self._correct(at, bit, place, foretold, tree)
                if tree == 0:  # the match model's few slots
                    match = at.pop() - 2 * FIRST[PREDICTORS - 1]
                    self.table[2 * FIRST[PREDICTORS - 1] :][:64] += np.bincount(match, minlength=64).astype(self.table.dtype)
                for a in at:
                    np.add.at(self.table, a, ones[: len(a)])

    def _correct(self, at: list[np.ndarray], bit: np.ndarray, place: np.ndarray, foretold: np.ndarray, tree: int) -> None:
        odds, seen = [], []
        pairs = self.table.view(np.uint64)  # both counts of a slot at once
        for k, a in enumerate(at):
            counts = pairs.take(a >> 1, mode="clip").view(self.table.dtype).reshape(-1, 2)
            if k in (1, 2):
                seen.append(_CLASS.take(np.minimum(counts[:, 0] + counts[:, 1], 1001), mode="clip"))
            own = counts.astype(np.float32)
            own += np.float32(PRIOR)
            x = own[:, 1] / own[:, 0]
            odds.append(np.log(x, out=x))
        gate = _gate(*seen, foretold, tree)
        mixed = _mixed(self.weights.T.astype(np.float32), gate, odds)
        error = bit.astype(np.float32) - _chance(mixed)
        slope = np.stack([np.bincount(gate, error * x, GATES) for x in odds], 1)
        slope /= np.maximum(np.bincount(gate, minlength=GATES), 50)[:, None]
        self.squares += slope * slope
        self.weights += RATE * slope / np.sqrt(self.squares)
        cell = _interval(mixed, place, tree)
        cell *= 2
        cell += bit
        both = np.bincount(cell, minlength=2 * PLACES * LEVELS).reshape(-1, 2)
        self.hits += both[:, 1]
        self.total += both.sum(1)
        self.mass += len(bit)


class Mixer:
    """The trained model: scores texts."""

    def __init__(self, code: Code, table: np.ndarray, weights: np.ndarray, hits: np.ndarray, total: np.ndarray):
        self.code, self.odds = code, np.empty(SLOTS, np.int16)  # the odds in STEPS, and in the low three bits how well the slot is known
        for at in range(0, SLOTS, 1 << 18):  # a part at a time, so that little is held
            zeros, ones = table[at : at + (1 << 18), 0], table[at : at + (1 << 18), 1]
            odds = np.log(ones + np.float32(PRIOR)) - np.log(zeros + np.float32(PRIOR))
            self.odds[at : at + (1 << 18)] = np.clip(np.rint(odds * STEPS), -2000, 2000).astype(np.int16) * 8 + _classes(zeros + ones)
        self.weights = np.ascontiguousarray(weights.T / STEPS, np.float32)
        centre = _chance((np.arange(LEVELS) - 16) / 2)
        self.refined = ((hits.reshape(PLACES, LEVELS) + 20 * centre) / (total.reshape(PLACES, LEVELS) + 20)).ravel().astype(np.float32)

    def score(self, t: Tokens, n: int) -> np.ndarray:
        """log10 probability of t's tokens by text, of n texts."""
        out = np.zeros(n)
        for owner, slots, bit, place, foretold, tree in walk(self.code, t):
            odds = [self.odds.take(s, mode="clip") for s in slots]
            gate = _gate(odds[1] & 7, odds[2] & 7, foretold, tree)
            mixed = _mixed(self.weights, gate, [x >> 3 for x in odds])
            p = (_chance(mixed) + self.refined.take(_interval(mixed, place, tree), mode="clip")) / 2
            out += np.bincount(owner, np.log(np.abs((1 - bit).astype(np.float32) - p)), n)
        return out / np.log(10)
