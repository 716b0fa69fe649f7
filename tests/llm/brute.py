"""Plain Python versions of the operators' contracts, row by row."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def decontaminate(docs, items, size=10):
    """docs: (id, text); items: (id, text)."""
    windows = []
    for item, text in items:
        w = ALNUM.findall(low(text or ""))
        n = min(size, len(w))
        windows += [(item if item is not None else "", tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for doc, text in docs:
        w = ALNUM.findall(low(text or ""))
        hit, found = set(), set()
        by = {n: defaultdict(list) for n in {len(x) for _, x in windows}}
        for n, at in by.items():
            for i in range(len(w) - n + 1):
                at[tuple(w[i : i + n])].append(i)
        for item, x in windows:
            for i in by[len(x)].get(x, ()):
                hit |= set(range(i, i + len(x)))
                found.add(item)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def text_counts(text):
    text = text or ""
    w = SPACE.findall(text)
    chars = sum(map(len, w))
    symbols = sum(c in "#*$%&|<>" for c in text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(w)
    return n, chars, symbols, len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n


def line_dedup(docs):
    """docs: (id, text) with unique ids that are not null."""
    holders = defaultdict(set)
    key = lambda x: low(x.strip(" \t\n\x0b\f\r"))
    for doc, text in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def near_dup(docs, n=5, percent=75):
    """docs: (id, text); (id, n_shingles, component, kept) by all pairs that share a shingle."""
    sets, holders = {}, defaultdict(list)
    for doc, text in docs:
        w = SPACE.findall(low(text or ""))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        for s in sets[doc]:
            holders[s].append(doc)
    shared = defaultdict(int)
    for v in holders.values():
        for i, a in enumerate(v):
            for b in v[i + 1 :]:
                shared[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [(d, len(sets[d]), find(d), find(d) == d) for d, _ in docs]


def phrases(text):
    """n_words, n_base, first, last, base labels."""
    w = ALNUM.findall(low(text or ""))
    at, labels = [], set()
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def chat(turns):
    """turns: (conv, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: r[0])
        loss = "".join(t for _, r, t in rows if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss))
    return out


def outliers(rows):
    """id -> (squared distance, kept) by the estimate of each group; rows: (id, text, lang, source)."""
    import math

    import numpy as np

    from gleanery.llm import quality as Q

    counts = {r[0]: text_counts(r[1]) for r in rows}
    vector = {}
    for doc, text, _, _ in rows:
        n, chars, symbols, dup, again, _ = counts[doc]
        upper = sum("A" <= c <= "Z" for w in SPACE.findall(text or "") for c in w)
        lines = sum(bool(SPACE.search(x)) for x in (text or "").split("\n"))
        vector[doc] = np.array([math.log((chars + 250) / (n + 50)), math.log1p(100 * symbols / (chars + 200)), math.sqrt(again / (n + 50)), math.sqrt(dup / (lines + 5)), math.sqrt(upper / (chars + 200))])
    good = [r for r in rows if not counts[r[0]][5]]
    sources, langs = defaultdict(int), defaultdict(int)
    for _, _, lang, source in rows:
        sources[lang, source] += 1
        langs[lang] += 1
    name = lambda r: ("s", r[2], r[3]) if sources[r[2], r[3]] >= Q.MIN_ROWS else ("l", r[2]) if langs[r[2]] >= Q.MIN_ROWS else ("all",)
    floors = np.array(Q.FLOORS)

    def quantile(bins, share):
        return sorted(bins)[math.ceil(len(bins) * share) - 1]

    def distances(x, m, low):
        return [float(sum(v * v for v in np.linalg.solve(low, y - m))) for y in x]

    bin_ = lambda d: math.floor(16 * math.log2(d + 1e-9))
    estimate = {}
    for g in {name(r) for r in good}:
        x = np.array([vector[r[0]] for r in good if (g[0] == "s" and name(r) == g) or (g[0] == "l" and r[2] == g[1]) or g[0] == "all"])
        mid = np.array([(quantile([math.floor(v * 256) for v in col], 0.5) + 0.5) / 256 for col in x.T])
        mad = np.array([(quantile([math.floor(abs(v - c) * 256) for v in col], 0.5) + 1) / 256 * 1.4826 for col, c in zip(x.T, mid, strict=True)])
        ends = []
        for k, scale in enumerate((np.maximum(mad, floors), floors)):
            m, low = mid, np.diag(scale)
            for _ in range(Q.STEPS):
                bins = [bin_(d) for d in distances(x, m, low)]
                near = x[np.array(bins) <= quantile(bins, Q.SUPPORT)]
                m, low = near.mean(axis=0), np.linalg.cholesky(np.cov(near.T, bias=True) + np.diag(floors**2))
            ends.append((np.log(np.diag(low)).sum(), k, m, low))
        _, _, m, low = min(ends, key=lambda e: e[:2])
        middle = quantile([bin_(d) for d in distances(x, m, low)], 0.5)
        estimate[g] = m, low, max(2 ** ((middle + 1) / 16) / Q.CHI2_MEDIAN, 1.0)
    out = {}
    for r in rows:
        m, low, scale = estimate.get(name(r), (None, None, None))
        d = distances([vector[r[0]]], m, low)[0] / scale if m is not None else None
        out[r[0]] = d, not counts[r[0]][5] and (d is None or d <= Q.CUTOFF)
    return out
