"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark, texts, langs=None, sources=None, ids=None, extra=""):
    n = len(texts)
    rows = [(ids[k] if ids else k, texts[k], langs[k] if langs else "en", sources[k] if sources else "s", len(texts[k] or "")) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def suffix_spans(texts, length):
    """Covered byte ranges of each text: windows of ``length`` that start at two places."""
    seen = Counter()
    for t in texts:
        seen.update(t[p : p + length] for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                covered[p : p + length] = [True] * length
        spans, p = [], 0
        while p < len(t):
            if covered[p]:
                q = p
                while q < len(t) and covered[q]:
                    q += 1
                spans.append((p, q))
                p = q
            else:
                p += 1
        out.append(spans)
    return out


def line_dedup(docs, min_chars=20, min_docs=3):
    """``{id: (n_lines, n_dropped, kept text)}`` of ``{id: text}``."""
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(low)
    held = defaultdict(set)
    for d, t in docs.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and d != max(held[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text, words):
    w = WORD.findall((text or "").encode().translate(FOLD))
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def components(docs, words=4, percent=85):
    """``{id: (set size, smallest id reachable)}``."""
    sets = {d: shingles(t, words) for d, t in docs.items()}
    lead = {d: d for d in docs}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            lead[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
