"""Brute-force versions of the operators, as plain loops over small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np

from lodestone.llm.decontamination import LEAST, MASKS, SHORTEST, SPAN
from lodestone.llm.url_filter import ALPHABET, BINS, ORDER, PAD, SMOOTH

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    """docs: (doc_id, text) -> {doc_id: (shingles, component)}; all pairs are compared."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 4 * min(len(sets[a]), len(sets[b])) < 3 * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def stretch(doc, item, shift):
    best, score, first, same = (0, 0, -1, 0), 0, 0, 0
    for i, token in enumerate(item):
        hit = 0 <= i + shift < len(doc) and doc[i + shift] == token
        if score <= 0:
            score, first, same = 0, i, 0
        score, same = score + (1 if hit else -1), same + hit
        if score > best[0]:
            best = (score, first, i, same)
    return best


def leaks(docs, items):
    """{(doc_id, item_id): (matched, length, doc_start)}"""
    kept = [[k for k, on in enumerate(m) if on == "1"] for m in MASKS]
    places = {}
    told = {i: words(t) for i, t in items}
    for i, item in told.items():
        for m, mask in enumerate(kept):
            for at in range(len(item) - SPAN + 1):
                places.setdefault((m, *[item[at + k] for k in mask]), []).append((i, at))
        if SHORTEST <= len(item) < SPAN:
            places[("whole", *item)] = [*places.get(("whole", *item), []), (i, 0)]
    out = {}
    for d, text in docs:
        doc = words(text)
        shifts = {(i, at - j) for m, mask in enumerate(kept) for at in range(len(doc) - SPAN + 1) for i, j in places.get((m, *[doc[at + k] for k in mask]), ())}
        shifts |= {(i, at) for n in range(SHORTEST, SPAN) for at in range(len(doc) - n + 1) for i, _ in places.get(("whole", *doc[at : at + n]), ())}
        for i, shift in shifts:
            score, first, last, same = stretch(doc, told[i], shift)
            if score >= min(LEAST, len(told[i])):
                found = (same, last - first + 1, -(shift + first))
                out[d, i] = max(out.get((d, i), found), found)
    return {k: (same, length, -before) for k, (same, length, before) in out.items()}


def mix(docs):
    """docs: (doc_id, source, text) -> rows (size, source_size, target, copies) in the order of docs."""
    size = [len(words(t)) for _, _, t in docs]
    key = lambda s: (s is None, s or "")
    sources = sorted({s for _, s, _ in docs}, key=key)
    total = Counter()
    for (_, s, _), n in zip(docs, size, strict=True):
        total[s] += n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, target, free = float(sum(size)), {}, set(sources)
    while free:  # reshare what is above three times a source until nothing is
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * total[s] for s in over}
        left -= sum(3 * total[s] for s in over)
        free -= over
    place = [hashlib.md5(str(d).encode()).hexdigest() if d is not None else hashlib.md5(b"").hexdigest() for d, _, _ in docs]
    running, seen = [0] * len(docs), Counter()
    for k in sorted(range(len(docs)), key=lambda k: (place[k], docs[k][0] or 0, size[k])):
        seen[docs[k][1]] += size[k]
        running[k] = seen[docs[k][1]]
    passes = []
    for k, (_, s, _) in enumerate(docs):
        for e in range(3):
            passes.append(((e * total[s] + running[k]) / target[s] if target[s] > 0 else 2.0 * e, place[k], e, k))
    copies, taken = [0] * len(docs), 0
    for *_, k in sorted(passes):
        taken += size[k]
        if taken > sum(size):
            break
        copies[k] += 1
    return [(n, total[s], target[s], c) for (_, s, _), n, c in zip(docs, size, copies, strict=True)]


def url(text):
    if text is None or "://" not in text:
        return "", ""
    host = re.match(r"[^/?#]*", rest := text.split("://", 1)[1])[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_verdicts(pages, rules):
    """pages: (page_id, url) -> {page_id: (host, path, rule, verdict, score)}"""
    parsed, pages_of = {}, Counter()
    for p, u in pages:
        host, path = url(u)
        best = None
        for rule, verdict in rules:
            name, start = rule.split("/", 1)
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        parsed[p] = (host, path, best)
        pages_of[host + path, best and best[1]] += 1
    seen, ahead = {"allow": Counter(), "block": Counter()}, {"allow": Counter(), "block": Counter()}
    grams = lambda t: [(PAD * ORDER + t)[i : i + ORDER + 1] for i in range(len(t))]
    for (text, verdict), n in pages_of.items():
        if verdict:
            for g in grams(text):
                for k in range(1, ORDER + 2):
                    seen[verdict][g[-k:]] += n
                    ahead[verdict][k, g[-k:][:-1]] += n

    def log_p(gram, verdict):
        p = 1 / ALPHABET
        for k in range(1, ORDER + 2):
            p = (seen[verdict][gram[-k:]] + SMOOTH * p) / (ahead[verdict][k, gram[-k:][:-1]] + SMOOTH)
        return math.log(p)

    score = {t: sum(log_p(g, "allow") - log_p(g, "block") for g in grams(t)) / len(t) if t else 0.0 for t, _ in pages_of}
    judged = [(score[t], v) for t, v in pages_of if v and t]
    least = float("-inf")
    if len({v for _, v in judged}) == 2:
        low, high = min(judged)[0], max(judged)[0]
        width = (high - low) / BINS or 1.0
        n = Counter(v for _, v in judged)
        edges = sorted({math.floor((s - low) / width) for s, _ in judged})
        right = {e: sum(v == "block" and math.floor((s - low) / width) < e for s, v in judged) / n["block"] - sum(v == "allow" and math.floor((s - low) / width) < e for s, v in judged) / n["allow"] for e in edges}
        least = low + width * max(edges, key=lambda e: (right[e], -e))
    return {p: (h, s, b and b[0], b[1] if b else ("allow" if score[h + s] >= least else "block"), score[h + s]) for p, (h, s, b) in parsed.items()}


def mixed_score(model, train, text):
    """log10 probability of a text's tokens under a mixer's weights, by loops over exact contexts."""
    from lodestone.llm import context_mixing as cm
    from lodestone.llm.shingles import word_hashes

    code = model.code
    at = {h: k for k, h in enumerate(code.hashes.tolist())}
    n = len(at)

    def symbol(word):
        return n if word is None else at.get(int(word_hashes([word])[0][0]), n + 1)

    def path(codes, lengths, k):
        return format(int(codes[k]), f"0{int(lengths[k])}b")

    def decisions(text):
        """(tree, contexts, path so far, bit, foretold) one by one; contexts by predictor."""
        own = [*text.lower().split(), None]
        symbols = [symbol(w) for w in own]
        last, followed, run = [], {}, 0
        for i, w in enumerate(own):
            before = [own[i - k] if i >= k else "start" for k in (1, 2, 3)]
            expected, kind = None, 0
            if i >= 2 and tuple(before[:2]) in followed:
                j = followed[tuple(before[:2])]
                expected, kind = path(code.codes, code.lengths, symbols[j]), 1 + min(run, 14)
            contexts = [tuple(before[:1]), tuple(before[:2]), tuple(before), tuple(last[:2])]
            bits = path(code.codes, code.lengths, symbols[i])
            for d, b in enumerate(bits):
                told = kind * 2 + int(expected[d]) if kind and len(expected) > d and expected[:d] == bits[:d] else 0
                yield 0, [*contexts, None], bits[:d], int(b), told
            if symbols[i] == n + 1:
                letters = [*w, cm.STOP]
                for p, x in enumerate(letters):
                    back = [letters[p - k] if p >= k else -1 for k in (1, 2, 3, 4)]
                    own_contexts = [tuple(back[:2]), tuple(back[:3]), tuple(back), (*back[:2], *last[:1]), (*back[:3], *last[:1])]
                    bits = path(code.letter_codes, code.letter_lengths, x)
                    for d, b in enumerate(bits):
                        yield 1, own_contexts, bits[:d], int(b), 0
            run = run + 1 if kind and own[followed[tuple(before[:2])]] == w else 0
            if i >= 2:
                followed[tuple(before[:2])] = i
            if code.often[symbols[i]]:
                last = [w, *last[:1]]

    def slots(tree, contexts, above, told):
        return [("told", told) if k == 4 and not tree else (tree, k, c, above) for k, c in enumerate(contexts)]

    counts = {}
    for t in train:
        for tree, contexts, above, bit, told in decisions(t):
            for s in slots(tree, contexts, above, told):
                counts.setdefault(s, [0, 0])[bit] += 1
    total = 0.0
    for tree, contexts, above, bit, told in decisions(text):
        seen = [counts.get(s, [0, 0]) for s in slots(tree, contexts, above, told)]
        odds = [np.clip(np.rint(np.log((b + cm.PRIOR) / (a + cm.PRIOR)) * cm.STEPS), -2000, 2000) for a, b in seen]
        classes = [sum(sum(x) > y for y in (0.5, 2.5, 10, 60, 1000)) for x in seen]
        gate = ((classes[1] * 3 + min(classes[2], 2)) * 2 + (told > 0)) * 2 + tree
        mixed = float(sum(w * x for w, x in zip(model.weights[:, gate], odds, strict=True)))
        cell = (min(len(above), cm.PLACES // 2 - 1) * 2 + tree) * cm.LEVELS + int(np.clip(np.rint(mixed * 2), -16, 16)) + 16
        p = (1 / (1 + np.exp(-np.clip(mixed, -20, 20))) + model.refined[cell]) / 2
        total += np.log10(p if bit else 1 - p)
    return total
