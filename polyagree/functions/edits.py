"""Edit distances of many pairs of texts at once: columns of Myers' matrix as bits of words, a step for each character of the shorter text. Spark's own takes a step for each pair of characters."""

from __future__ import annotations

#: A pair by itself costs about as much as this many pairs in numpy's calls, for each word of its longer text.
ALONE = 18
#: Entries of a table of places of characters.
ENTRIES = 4_000_000


def one(longer: str, shorter: str) -> int:
    """Myers' algorithm with the longer text as one number."""
    m, at = len(longer), {}
    for i, c in enumerate(longer):
        at.setdefault(c, []).append(i)
    places = {}
    for c in set(shorter) & at.keys():
        mask = bytearray(m // 8 + 1)
        for i in at[c]:
            mask[i >> 3] |= 1 << (i & 7)
        places[c] = int.from_bytes(mask, "little")
    full = (1 << m) - 1
    up, down = full, 0
    for c in shorter:
        eq = places.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        ph = (ph << 1 | 1) & full
        up, down = (mh << 1) & full | full & ~(xv | ph), ph & xv
    return len(shorter) + up.bit_count() - down.bit_count()


def _filled(codes, starts, sizes, width: int):
    """The characters of texts as columns of a table."""
    import numpy as np

    out = np.zeros((width, len(sizes)), codes.dtype)
    row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, np.repeat(np.arange(len(sizes)), sizes)] = codes[np.repeat(starts, sizes) + row]
    return out


def _together(codes, letters: int, starts, sizes, longer, shorter):
    """Distances of pairs whose longer texts have as many words of 64 bits; pairs come by the length of the shorter, longest first."""
    import numpy as np

    texts, mine = np.unique(longer, return_inverse=True)
    most = int(sizes[texts].max())
    words = -(-most // 64)
    order = np.argsort(-sizes[texts], kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    mine, own = rank[mine] * letters, sizes[texts[order]]
    chars, base = _filled(codes, starts[texts[order]], own, most), np.arange(len(order)) * letters
    places = np.zeros((words, len(order) * letters), np.uint64)
    alive = np.searchsorted(-own, -np.arange(most), "left")
    for i in range(most):
        n = alive[i]
        places[i >> 6, base[:n] + chars[i, :n]] |= np.uint64(1 << (i & 63))
    size = sizes[shorter]
    steps = int(size[0])
    chars, alive = _filled(codes, starts[shorter], size, steps), np.searchsorted(-size, -np.arange(steps), "left")
    up, down = np.full((words, len(size)), ~np.uint64(0)), np.zeros((words, len(size)), np.uint64)
    last, first = np.uint64(63), np.uint64(1)
    for j in range(steps):
        n = alive[j]
        at = mine[:n] + chars[j, :n]
        plus, minus = first, None  # the first row grows by one a step
        for w in range(words):
            eq, pv, mv = places[w][at], up[w, :n], down[w, :n]
            xv = eq | mv
            if minus is not None:
                eq |= minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            over, under = ph >> last, mh >> last
            ph = ph << first | plus
            mh <<= first
            if minus is not None:
                mh |= minus
            up[w, :n], down[w, :n] = mh | ~(xv | ph), ph & xv
            plus, minus = over, under
    out = size.astype(np.int64)
    for w in range(words):
        bits = np.clip(sizes[longer] - 64 * w, 0, 64).astype(np.uint64)
        mask = np.where(bits == 64, ~np.uint64(0), (first << (bits & last)) - first)
        out += np.bitwise_count(up[w] & mask).astype(np.int64) - np.bitwise_count(down[w] & mask).astype(np.int64)
    return out


def distances(texts: list[str], codes, letters: int, starts, sizes, a, b):
    """Distances of the pairs of texts at places `a` and `b`; codes: characters of all texts as numbers below `letters`, those of a text from its start on."""
    import numpy as np

    swap = sizes[a] < sizes[b]
    longer, shorter = np.where(swap, b, a), np.where(swap, a, b)
    out = sizes[longer].astype(np.int64)  # of an empty text
    words = -(-sizes[longer] // 64)
    order = np.lexsort((-sizes[shorter], words))
    order = order[sizes[shorter[order]] > 0]
    for group in np.split(order, np.flatnonzero(np.diff(words[order])) + 1):
        if len(group) == 0:
            continue
        w = int(words[group[0]])
        if len(group) < ALONE * w:
            out[group] = [one(texts[longer[p]], texts[shorter[p]]) for p in group]
            continue
        step = max(1, ENTRIES // (letters * w))
        for i in range(0, len(group), step):
            part = group[i : i + step]
            out[part] = _together(codes, letters, starts, sizes, longer[part], shorter[part])
    return out


def greatest(lists: list[list[str] | None]):
    """For each list the most edits between any two of its texts, 0 for fewer than two.

    No pair is further apart than its longer text is long: the longest text is compared with all others, and of the others
    only those pairs with a text longer than the greatest distance so far.
    """
    import numpy as np

    best = np.zeros(len(lists), np.int64)
    kept = [(g, sorted((x for x in xs if x is not None), key=len, reverse=True)) for g, xs in enumerate(lists) if xs is not None and len(xs) > 1]
    texts = [x for _, xs in kept for x in xs]
    if not texts:
        return best
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    known, codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    letters, firsts, at = max(len(known), 1), [], 0
    for _, xs in kept:
        firsts.append(at)
        at += len(xs)

    def compared(groups, a, b):
        if a:
            np.maximum.at(best, np.array(groups), distances(texts, codes, letters, starts, sizes, np.array(a), np.array(b)))

    counts = [len(xs) for _, xs in kept]
    compared([g for (g, _), n in zip(kept, counts) for _ in range(n - 1)], [f for f, n in zip(firsts, counts) for _ in range(n - 1)], [f + i for f, n in zip(firsts, counts) for i in range(1, n)])
    size = sizes.tolist()
    left = [(g, f + i, f + k) for (g, _), f, n in zip(kept, firsts, counts) for i in range(1, n - 1) if size[f + i] > best[g] for k in range(i + 1, n)]
    compared(*map(list, zip(*left))) if left else None
    return best
