"""Plain Python models of what the operators promise."""

import random
import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(rows, width, num, den):
    """{id: (set size, component)} over (id, text) rows."""
    sets = {}
    for i, text in rows:
        w = words(ascii_lower(text))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    at = components(sets, links)
    return {i: (len(s), at[i]) for i, s in sets.items()}


def substring(rows, width):
    """{id: (words, removed, kept text)}: removes what a window that starts in a smaller id covers."""
    text = {i: words(t) for i, t in rows}
    first = {}
    for i in sorted(text):
        for j in range(len(text[i]) - width + 1):
            first.setdefault(tuple(text[i][j : j + width]), i)
    out = {}
    for i, w in text.items():
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), " ".join(kept))
    return out


def near_copies(n, seed, vocabulary=400, groups=8):
    """(id, text) rows with exact copies, edited copies, shared passages, shorts, empties and nulls."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    common = [rng.choice(vocab) for _ in range(60)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(20, 160))] for _ in range(groups)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 10])):
                at = rng.randrange(len(w) + 1)
                if rng.random() < 0.5:
                    w[at : at + 1] = [rng.choice(vocab)]
                else:
                    w.insert(at, rng.choice(vocab))
        elif kind < 0.7:
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
            w[rng.randint(0, len(w)) :][:0] = []
            at = rng.randint(0, len(w))
            w = w[:at] + common + w[at:]
        elif kind < 0.85:
            w = [rng.choice(vocab[:3]) for _ in range(rng.randint(0, 9))]
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        text = "".join(x + rng.choice([" ", " ", "\n", "\t ", "  "]) for x in w)
        if rng.random() < 0.3:
            text = text.upper() if rng.random() < 0.3 else text.title()
        rows.append((i * 3 + 1, None if rng.random() < 0.02 else text))
    return rows
