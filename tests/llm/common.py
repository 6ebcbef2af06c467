"""Texts that repeat in many ways, and brute force for them."""

import hashlib
import random
from collections import Counter


def sha(b):
    return hashlib.sha256(b).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def vocabulary(rng, n=300):
    return ["".join(rng.choice("abcdefgéAB") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def documents(seed=3, n=90):
    """(doc_id, text): shared passages, near copies, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 60))) for _ in range(10)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    long = " ".join(rng.choice(words) for _ in range(12_000)) + " " + passages[2]
    return rows + [(n, None), (n + 1, ""), (None, passages[0] + " x " + passages[1]), (5, rows[5][1]), (7, passages[3] + passages[3]), (n + 2, "a " * 250), (n + 3, "a " * 300), (n + 4, rows[10][1]), (n + 5, rows[10][1][5:]), (-5, rows[12][1]), (n + 6, long), (n + 7, " \n\t")]


def kept_words(rows, window=20):
    """(n_words, n_removed, digest) by (doc_id, text)."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i, t] = (len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def kept_bytes(rows, window=200, first=False):
    """(n_bytes, n_removed, n_spans, digest) by (doc_id, text)."""
    texts = {(i, t): (t or "").encode() for i, t in rows}
    count = Counter(b[s : s + window] for b in texts.values() for s in range(len(b) - window + 1))
    seen, out = set(), {}
    for key in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = texts[key]
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if (w in seen) if first else count[w] > 1:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out[key] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def shingle_set(text, k):
    words = lower(text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def classes(rows, k, num, den):
    """(doc_id, set size, smallest doc_id reachable) of each row."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]


def frame(spark, rows):
    """With more columns, one of a name that the operators use themselves."""
    return spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, score long, shard string")


def got(df):
    return sorted(map(tuple, df.collect()), key=str)
