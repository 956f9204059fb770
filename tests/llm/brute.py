"""Plain versions of what the operators compute, for small inputs."""

import re
import zlib

import numpy as np
import xxhash

UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER_TO_LOWER))


def fingerprint(text):
    w = words(text)
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    """Smallest reachable key for each (key, value)."""
    parent = {k: k for k, _ in items}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1:]:
            if linked(x, y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {k: root(k) for k, _ in items}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    only = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(only(m)) <= 19 and luhn(only(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(only(m)) <= 15]


def secrets(text):
    assign = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24])


def crc_fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def top_products(ids, vectors, query, k):
    at = ids.index(query)
    scores = np.array(vectors) @ np.array(vectors[at])
    order = sorted((-float(s), i) for s, i in zip(scores, ids) if i != query)
    return [(i, -s) for s, i in order[:k]]
