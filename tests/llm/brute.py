"""Plain Python versions of what the queries return, over lists of rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines, dup, seen = [x for x in text.split("\n") if WORDS.search(x)], 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def substring(docs, width=20):
    words = {i: WORDS.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][s:s + width]), (i, s))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s:s + width])] < (i, s):
                gone.update(range(s, s + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    kinds = Counter(x[3] for x in found)
    return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in found).encode()).hexdigest()


def lines(docs, min_sites=10):
    """docs: (id, text, site), ids distinct."""
    sites, first = defaultdict(set), {}
    for i, t, site in sorted(docs, key=lambda x: x[0]):
        for k, x in enumerate((t or "").split("\n")):
            x = x.strip(" \t\n\x0b\x0c\r")
            if x:
                first.setdefault(x, (i, k))
                if site is not None:
                    sites[x].add(site)
    out = {}
    for i, t, _ in docs:
        all_ = (t or "").split("\n")
        bare = [x.strip(" \t\n\x0b\x0c\r") for x in all_]
        stay = [k for k, x in enumerate(bare) if not x or len(sites[x]) < min_sites or first[x] == (i, k)]
        out[i] = (sum(bool(x) for x in bare), len(all_) - len(stay), "\n".join(all_[k] for k in stay))
    return out


def crc(data):
    return zlib.crc32(data)
