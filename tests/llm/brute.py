"""Plain Python versions that the operators are compared with."""

import re

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    """Of n things, the root of each under the links."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def fingerprint(text: str | None) -> int:
    import xxhash

    w = words(text)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def least(ids: list) -> int | None:
    ids = [i for i in ids if i is not None]
    return min(ids) if ids else None
