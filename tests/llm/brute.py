"""Plain versions of operators, one text or pair at a time."""

import hashlib
import re
from collections import Counter
from itertools import combinations


def words(text):
    return (text or "").encode().split()


def near_groups(rows, k=5, least=0.8):
    """A number for each row's group: rows (id, text) that links of labelled runs in the same order reach."""
    runs = []
    for _, text in rows:
        w, seen, out = words(text), Counter(), []
        for j in range(max(len(w) - k + 1, 1 if w else 0)):
            run = tuple(w[j : j + k])
            out.append((run, seen[run]))
            seen[run] += 1
        runs.append(out)
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    at = {}
    for i, own in enumerate(runs):
        for run in own:
            at.setdefault(run, []).append(i)
    for i, j in {p for own in at.values() for p in combinations(own, 2)}:
        a, b = runs[i], runs[j]
        shared = set(a) & set(b)
        if len(shared) >= least * (len(a) + len(b) - len(shared)) - 1e-9:
            place = {run: n for n, run in enumerate(b)}
            order = [place[run] for run in a if run in shared]
            tails = []
            for y in order:
                spot = next((n for n, t in enumerate(tails) if t >= y), len(tails))
                tails[spot : spot + 1] = [y]
            n = len(tails)
            if n >= least * (len(a) + len(b) - n) - 1e-9:
                group[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def near_classes(rows, **options):
    """The smallest id of each row's group."""
    groups, least = near_groups(rows, **options), {}
    for g, (i, _) in zip(groups, rows, strict=True):
        least[g] = min(least.get(g, i), i)
    return [least[g] for g in groups]


def kept_words(rows, size=50):
    """For each row (id, text) the words that no window of a row with a smaller id covers."""
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    out = []
    for i, text in rows:
        w = words(text)
        keep = [True] * len(w)
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j : j + size])] < i:
                keep[j : j + size] = [False] * size
        out.append([x for x, k in zip(w, keep, strict=True) if k])
    return out


def holds_item(text, items, k=5, least=0.8):
    x = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    for item in items:
        w = [t for t in re.split(r"[\W_]+", (item or "").lower()) if t]
        n = min(k, len(w))
        if not w or len(x) < n:
            continue
        own = Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
        runs = [tuple(x[j : j + n]) for j in range(len(x) - n + 1)]
        if not any(r in own for r in runs):
            continue
        for s in range(max(1, len(x) - len(w) + 1)):
            there = Counter(runs[s : s + len(w) - n + 1])
            if sum((there & own).values()) / sum((there | own).values()) >= least - 1e-9:
                return True
    return False


def features(text, bits):
    """Hashed features of the toxicity chain, word by word."""
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    marks = set(range(0x21, 0x30)) | set(range(0x3A, 0x41)) | set(range(0x5B, 0x61)) | set(range(0x7B, 0x7F))
    out = set()
    for word in words(text):
        word = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        for _ in range(4):
            word = word[1:] if len(word) > 1 and word[0] in marks else word
            word = word[:-1] if len(word) > 1 and word[-1] in marks else word
        for kind, most in enumerate((None, 4, 5)):
            if most is None or len(word) > most:
                part = word[:most]
                h = mixed((sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(part)) + len(part) * 0xD6E8FEB86659FD93) & mask)
                out.add(((h + kind * 0x51ED270B) & mask) >> (64 - bits))
    return out


def digest(kept):
    return hashlib.sha256(b" ".join(kept)).hexdigest()
