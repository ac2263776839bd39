"""Plain single-machine versions of the registered results, for small tables."""

import collections
import hashlib
import html
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def main_text(page):
    found = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1|div)[^>]*>", found[1]) if found else []
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts)
    return "\n".join(x for x in lines if x)


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, again, len(inside), failed


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def line_dedup(docs):
    holders, last = collections.Counter(), {}
    keys = {}
    for n, (i, text) in enumerate(docs):
        keys[n] = [lower(x.strip(" \t\n\v\f\r")) for x in (text or "").split("\n")]
        for k in set(keys[n]):
            if len(k) >= 40:
                holders[k] += 1
                if i is not None and (last.get(k) is None or i > last[k]):
                    last[k] = i
    out = []
    for n, (i, text) in enumerate(docs):
        lines = (text or "").split("\n")
        keep = [x for x, k in zip(lines, keys[n], strict=True) if holders[k] < 5 or last.get(k) == i]
        out.append((i, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


def luhn(span):
    digits = [int(c) for c in span if c.isdigit()]
    doubled = (sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def personal(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if luhn(m[0])]
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def secrets(text):
    text, out = text or "", []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def spans(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def shard(doc_id, shards):
    digest = hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()
    return jump(int(digest[:16], 16), shards)


def targets(sizes):
    """Water filling, a source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and 3 * sizes[s] < weight[s] * left / share} if share else set()
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * left / share for s in names}
        full |= over


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(docs, percent):
    """Component of each row by all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and root(i) != root(j):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(docs):
        r = root(i)
        known = lowest.get(r)
        lowest[r] = doc_id if known is None or (doc_id is not None and doc_id < known) else known
    return [(d, len(sets[i]), lowest[root(i)]) for i, (d, _) in enumerate(docs)]


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
