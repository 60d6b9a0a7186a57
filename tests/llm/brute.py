"""Plain rewritings of the contracts, one text at a time, to hold the operators against."""

import hashlib
import re


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    )
    out = []
    for rank, (kind, pattern, good) in enumerate(rules):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}", kind) for m in re.finditer(pattern, text or "") if good(m[0])]
    return sorted(out)


def personal(text):
    spans = base_spans(text)
    counts = tuple(sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone"))
    return (*counts, hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest())


def simhash(text, width=4):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    wide = min(width, len(words))
    shingles = [" ".join(words[i : i + wide]) for i in range(len(words) - wide + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(prints, distance=4):
    """Least id that links reach, for {id: fingerprint}; all pairs are compared."""
    import numpy as np

    values = sorted(set(prints.values()))
    x = np.array(values, dtype=np.uint64)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    place = {v: find(i) for i, v in enumerate(values)}
    least = {}
    for doc, v in prints.items():
        least[place[v]] = min(doc, least.get(place[v], doc))
    return {doc: least[place[v]] for doc, v in prints.items()}


def leaks(texts, items, least=0.8, width=5):
    """{(doc, item): best similarity} over all item-sized windows, for {id: text} of both; weights as in the operator."""
    import math
    from collections import Counter

    def cut(ws):
        k = min(width, len(ws))
        return Counter(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else Counter()

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = {i: cut(split(t)) for i, t in items.items()}
    sizes = {i: len(split(t)) for i, t in items.items()}
    spread = Counter(s for c in held.values() for s in c)
    weigh = lambda s: max(1, round(16 * math.log(1 + len(items) / max(1, spread[s]))))
    found = {}
    for doc, text in texts.items():
        ws = split(text)
        for i, other in held.items():
            size = min(sizes[i], len(ws))
            if not size:
                continue
            for start in range(len(ws) - size + 1):
                window = cut(ws[start : start + size])
                both = sum(min(n, other[s]) * weigh(s) for s, n in window.items())
                if both:
                    every = sum(max(n, other[s]) * weigh(s) for s, n in window.items()) + sum(n * weigh(s) for s, n in other.items() if s not in window)
                    score = both / every
                    if score >= least:
                        found[doc, i] = max(score, found.get((doc, i), 0))
    return found
