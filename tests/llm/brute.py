"""Plain Python versions of the operators' results, quadratic where that is simplest."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WHITE = " \t\n\v\f\r"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words_of(text):
    return WORD.findall(text or "")


def near_groups(docs, shingle=2, percent=80):
    """(doc_id, text) rows -> {doc_id: (n_shingles, component)}; ids are distinct."""
    sets = {}
    for i, text in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
        k = min(shingle, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, holders = sorted(sets), defaultdict(list)
    shared = Counter()
    for i in ids:
        for s in sets[i]:
            for j in holders[s]:
                shared[j, i] += 1
            holders[s].append(i)
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeats(docs, window=13):
    """(doc_id, text) rows -> {doc_id: (n_words, n_removed, kept_sha256)}."""
    first = {}
    for i, text in docs:
        w = words_of(text)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in docs:
        w = words_of(text)
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    times = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    rep = set()
    for j in range(len(w) - 2):
        if times[tuple(w[j : j + 3])] > 1:
            rep.update((j, j + 1, j + 2))
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), failed


def mix_targets(sizes, weights=(1, 2, 3), repeats=3):
    """{source: size} -> {source: target}, by resharing round after round."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        over = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: repeats * sizes[s] for s in over}
