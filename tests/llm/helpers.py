"""Fixtures shared by the tests of rasterloom.llm, and plain versions of what its operators compute."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows, extra=""):
    """(id, text[, source[, lang]]) as a documents table; ``extra``: further columns, filled with 1."""
    names = [c.split()[0] for c in extra.split(",") if c]
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None, *[1] * len(names)) for r in rows]
    return spark.createDataFrame(full, DOCS + (", " + extra if extra else ""))


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(rows):
    """(id, set size, component) of (id, text) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def dedup_lines(rows):
    """(id, lines, dropped, kept text) of (id, text) with distinct ids."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def remove_repeats(rows, depth):
    """(bytes, removed, spans, kept) per row, by counting every window."""
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in texts:
        for s in range(len(b) - depth + 1):
            seen[b[s : s + depth]] = seen.get(b[s : s + depth], 0) + 1
    out = []
    for b in texts:
        gone = [False] * len(b)
        for s in range(len(b) - depth + 1):
            if seen[b[s : s + depth]] > 1:
                gone[s : s + depth] = [True] * depth
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out
