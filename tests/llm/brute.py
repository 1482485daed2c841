"""Plain Python versions of the operators, by definition and without regard to cost."""

from __future__ import annotations

import collections
import hashlib
import re

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(text: str | None) -> str:
    out = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (size of the set, smallest doc_id reachable); ids are distinct."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if min(len(sets[a]), len(sets[b])) * 4 >= max(len(sets[a]), len(sets[b])) * 3:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def without_repeats(rows: list[tuple[int, str | None]], width: int = 50) -> dict[int, tuple[int, int, int, str]]:
    first: dict[bytes, int] = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - width + 1):
            first[data[k : k + width]] = min(i, first.get(data[k : k + width], i))
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - width + 1):
            if first[data[k : k + width]] < i:
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def levelled(sizes: dict, weights=(3, 1, 2), share: float = 1.5, cap: float = 2) -> dict:
    """Targets by handing out what is left, again and again."""
    names = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    out, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[k] for k in free)
        for k in free:
            out[k] += left * weight[k] / total
        left = 0.0
        for k in [*free]:
            if out[k] > cap * sizes[k]:
                left += out[k] - cap * sizes[k]
                out[k] = float(cap * sizes[k])
                free.discard(k)
    return out


def previous_factors(windows: list[bytes], docs: list[int]) -> list[int]:
    def common(a: bytes, b: bytes) -> int:
        n = 0
        while n < len(a) and a[n] == b[n]:
            n += 1
        return n

    return [max((common(w, v) for v, e in zip(windows, docs) if e < d), default=0) for w, d in zip(windows, docs)]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counted(rows) -> collections.Counter:
    return collections.Counter(map(tuple, rows))
