"""Plain loops over whole texts, written from the contracts alone."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import xxhash


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def simhash(docs):
    def fp(t):
        w = spaced(ascii_lower(t))
        if not w:
            return 0
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [fp(t) for _, t in docs]
    comp = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for (d, _), c in zip(docs, comp):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return [(d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(docs, fps, comp)]


def leaks(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    wins = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, items = set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in wins:
                    hit.update(range(k, k + size))
                    items |= wins[x]
        ids = ",".join(sorted(str(i) for i in items if i is not None))
        out.append((d, len(w), len(hit), len({i for i in items if i is not None}), sha(ids), bool(hit)))
    return out


def secrets(t):
    t = t or ""
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [sum(k == i for _, k, _ in found) for i in range(3)], ",".join(x for _, _, x in sorted(found))


def personal(t):
    t = t or ""
    n = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(n(x)) <= 19 and luhn(n(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(n(x)) <= 15),
    ]
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(tests) for m in re.finditer(p, t) if ok(m[0])]
    return [sum(k == i for _, k, _ in found) for i in range(4)], ",".join(x for _, _, x in sorted(found))


def base_scores(docs):
    held = lambda d: d is not None and crc32(str(d).encode()) % 7 == 2
    c = Counter()
    for d, t in docs:
        if not held(d):
            c.update([*spaced(ascii_lower(t)), None])
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in docs:
        w = [*spaced(ascii_lower(t)), None]
        out.append((d, held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


def repeats(docs):
    seen, out = set(), []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def fingerprint(text):
    """The set of kept numbers and the fingerprint, window by window with Python's integers."""
    import base64

    raw, kept, low = text.encode(), set(), 2**64 - 1
    padded = raw.ljust(16, b"\0") if raw else b""
    for i in range(len(padded) - 15):
        a, b = (int.from_bytes(padded[i + k : i + k + 8], "little") for k in (0, 8))
        h = a * 0x9E3779B97F4A7C15 & low
        h ^= h >> 32
        h = (h + b) * 0xC2B2AE3D27D4EB4F & low
        h ^= h >> 29
        h = (h * 0x165667B19E3779F9 & low) >> 32
        if h < 2**32 // 32:
            kept.add(h >> 3)
    return kept, base64.b64encode(len(raw).to_bytes(4, "big") + b"".join(k.to_bytes(3, "big") for k in sorted(kept))).decode()
