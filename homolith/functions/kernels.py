"""Numeric kernels in numpy: Rips persistence, bottleneck distance, spectral embedding, linkage, exact Kolmogorov-Smirnov."""

from __future__ import annotations

from math import comb

import numpy as np


def distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0.0))
    np.fill_diagonal(d, 0.0)
    return d


def rips_h0(d: np.ndarray) -> np.ndarray:
    """Deaths of components: the edges of a minimum spanning tree (Prim), in order."""
    n = len(d)
    near, out, inside = d[0].copy() if n else np.zeros(0), [], np.zeros(n, dtype=bool)
    if n:
        inside[0] = True
    for _ in range(n - 1):
        i = int(np.where(inside, np.inf, near).argmin())
        out.append(near[i])
        inside[i] = True
        near = np.minimum(near, d[i])
    return np.sort(np.array(out))


def rips_h0_points(x: np.ndarray) -> np.ndarray:
    """rips_h0() of points: distances to one point at a time, over the points that are still outside. The edges' lengths are those of
    differences, so that a copy's is 0."""
    n = len(x)
    rest, place = np.array(x[1:], float), np.arange(1, n)
    square, near, by = (rest * rest).sum(axis=1), np.full(max(n - 1, 0), np.inf), np.zeros(max(n - 1, 0), np.int64)
    out, last = np.zeros(max(n - 1, 0)), 0
    for m in range(n - 1, 0, -1):
        v = np.asarray(x[last], float)
        d = square[:m] + v @ v - 2 * (rest[:m] @ v)
        nearer = d < near[:m]
        near[:m][nearer] = d[nearer]
        by[:m][nearer] = last
        k = int(near[:m].argmin())
        last = int(place[k])
        out[m - 1] = np.sqrt(((rest[k] - x[by[k]]) ** 2).sum())
        for held in (rest, place, square, near, by):
            held[k] = held[m - 1]
    return np.sort(out)


#: Columns of a table of classes of loops that are held at least before equal ones are joined: 8 bytes each for 64 loops that live at once.
COLUMNS = 65_536


def rips_h1(d: np.ndarray, threshold: float = np.inf) -> np.ndarray:
    """(birth, death) of loops that die up to a threshold, from a class of loops held for each edge.

    Past the enclosing radius the complex is a cone, so edges beyond it are left out. Edges come by length. One that joins two
    components gets the class 0, another one that closes no triangle bears a loop and gets a class of its own, and one that
    closes triangles gets the sum of the classes of the other two sides of the first. A further triangle of which the sum is another
    one ends the youngest loop of the difference, which is added to all classes that hold this loop. So a class is a set of living
    loops, and no triangle is held. Sets have a column in a table with a bit for each living loop, and a name: the sum of random 64-bit numbers of
    their loops. Names are compared instead of sets (two sets have the same one with a chance of 2^-64)."""
    n = len(d)
    if n < 3:
        return np.zeros((0, 2))
    limit = min(d.max(axis=1).min(), threshold)
    i, j = np.triu_indices(n, 1)
    keep = d[i, j] <= limit
    i, j = i[keep], j[keep]
    order = np.lexsort((j, i, d[i, j]))
    i, j = i[order], j[order]
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    near, there, column = [0] * n, np.zeros((n, n), bool), np.zeros((n, n), np.int32)  # of the edges so far
    room = max(COLUMNS, 2)
    names, sets, used = np.zeros(room, np.uint64), np.zeros((1, room), np.uint64), 1  # the first column is the empty set
    born: dict[int, tuple[int, float]] = {}  # the living loops by their bits: the edge and its length
    free, draw, out = list(range(64)), np.random.default_rng(1), []

    def new_column() -> int:
        nonlocal names, sets, used, column
        if used == len(names):
            _, at, to = np.unique(names, return_index=True, return_inverse=True)
            column, used = to.astype(np.int32)[column], len(at)
            more = max(COLUMNS, 2 * used) - used
            names, sets = np.pad(names[at], (0, more)), np.pad(sets[:, at], ((0, 0), (0, more)))
        used += 1
        return used - 1

    for e, (a, b, length) in enumerate(zip(i.tolist(), j.tolist(), d[i, j].tolist(), strict=True)):
        common = near[a] & near[b]
        near[a] |= 1 << b
        near[b] |= 1 << a
        if not common:
            x, y = find(a), find(b)
            if x != y:
                root[x] = y
            else:
                if not free:
                    free = list(range(64 * len(sets), 128 * len(sets)))
                    sets = np.concatenate([sets, np.zeros_like(sets)])
                bit, k = free.pop(), new_column()
                sets[bit // 64, k] = np.uint64(1 << bit % 64)
                names[k] = draw.integers(1, 2**64, dtype=np.uint64)
                column[a, b] = column[b, a] = k
                born[bit] = (e, length)
        elif born:
            at = np.flatnonzero(there[a] & there[b])
            ca, cb = column[a, at], column[b, at]
            sums = names[ca] ^ names[cb]
            while (other := sums != sums[0]).any():
                k = int(other.argmax())
                ends = sets[:, ca[0]] ^ sets[:, cb[0]] ^ sets[:, ca[k]] ^ sets[:, cb[k]]
                bit = max(_places(int.from_bytes(ends.astype("<u8").tobytes(), "little")), key=born.__getitem__)
                birth = born.pop(bit)[1]
                if length > birth:
                    out.append((birth, length))
                free.append(bit)
                hold = np.flatnonzero(sets[bit // 64, :used] & np.uint64(1 << bit % 64))
                words = np.flatnonzero(ends)
                sets[words[:, None], hold] ^= ends[words, None]
                names[hold] ^= sums[k] ^ sums[0]
                sums = names[ca] ^ names[cb]
            if sums[0]:
                k = new_column()
                sets[:, k] = sets[:, column[a, at[0]]] ^ sets[:, column[b, at[0]]]
                names[k] = sums[0]
                column[a, b] = column[b, a] = k
        there[a, b] = there[b, a] = True
    return np.array(sorted(out)).reshape(-1, 2)


def _places(bits: int) -> list[int]:
    """The places of a number's ones."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")).tolist()


def _reaching(a: np.ndarray, b: np.ndarray, must: np.ndarray, r: float, known: dict[int, int]) -> bool:
    """Whether every point of a in `must` can have a point of b of its own no further than r (Hopcroft-Karp; b is in order of birth,
    sets of its points are numbers with a bit for each). It starts from the pairs that are `known` from a smaller r, and leaves there what it found if that isn't enough."""
    low, high = np.searchsorted(b[:, 0], a[must, 0] - r * (1 + 1e-12) - 1e-300), np.searchsorted(b[:, 0], a[must, 0] + r * (1 + 1e-12) + 1e-300, "right")
    x, y = b.T.copy()
    close = lambda p, s, t: (np.abs(x[s:t] - p[0]) <= r) & (np.abs(y[s:t] - p[1]) <= r)
    ways = [int.from_bytes(np.packbits(close(p, s, t), bitorder="little").tobytes(), "little") << s if t > s else 0 for p, s, t in zip(a[must].tolist(), low.tolist(), high.tolist(), strict=True)]
    if not all(ways):
        return False
    # Whoever has as many partners as there are others finds one last.
    count = [w.bit_count() for w in ways]
    order = sorted(range(len(ways)), key=lambda u: count[u])
    while order and count[order[-1]] >= len(order):
        order.pop()
    ways, who = [ways[u] for u in order], must[order].tolist()
    mate = [known.get(w, -1) for w in who]
    of = {v: u for u, v in enumerate(mate) if v >= 0}
    every = (1 << len(b)) - 1
    free = every
    for v in of:
        free ^= 1 << v
    for u in range(len(ways)):
        some = ways[u] & free if mate[u] < 0 else 0
        if some:
            v = (some & -some).bit_length() - 1
            mate[u], of[v] = v, u
            free ^= 1 << v
    while True:
        start = [u for u, m in enumerate(mate) if m < 0]
        if not start:
            return True
        # Layers of shortest paths: a point of b is in one of them only.
        layers, unseen, queue = [], every, start
        while True:
            layer = 0
            for u in queue:
                layer |= ways[u]
            layer &= unseen
            if not layer:
                known.clear()
                known.update({w: m for w, m in zip(who, mate, strict=True) if m >= 0})
                return False
            if layer & free:
                layers.append(layer & free)
                break
            layers.append(layer)
            unseen ^= layer
            queue = [of[v] for v in _places(layer)]
        # Whoever is tried is used up for this round, whether a path came of it or not.
        for first in start:
            path, taken = [first], []
            while path:
                at = len(path) - 1
                some = ways[path[-1]] & layers[at]
                if not some:
                    path.pop()
                    if taken:
                        taken.pop()
                    continue
                bit = some & -some
                layers[at] ^= bit
                taken.append(bit.bit_length() - 1)
                if at + 1 < len(layers):
                    path.append(of[taken[-1]])
                    continue
                for u, v in zip(path, taken, strict=True):
                    mate[u], of[v] = v, u
                free ^= bit
                break


def bottleneck(a: np.ndarray, b: np.ndarray) -> float:
    """Least largest move that matches two diagrams; a point may be matched to the diagonal at half its persistence.

    Within r, only points of more than twice that persistence need a partner. If those of either side can all have one, then both
    can at once (Mendelsohn and Dulmage), so each side is asked alone, by layers of shortest paths over the points that are near.
    It is looked for upwards from what no point can do without, so that the pairs found on the way stay, and then among the
    distances that are left."""
    a, b = np.asarray(a, float).reshape(-1, 2), np.asarray(b, float).reshape(-1, 2)
    if not len(a) and not len(b):
        return 0.0
    a, b = a[np.argsort(a[:, 0], kind="stable")], b[np.argsort(b[:, 0], kind="stable")]
    ha, hb = (a[:, 1] - a[:, 0]) / 2, (b[:, 1] - b[:, 0]) / 2

    pairs: tuple[dict[int, int], dict[int, int]] = ({}, {})

    def fits(r: float) -> bool:
        return all(_reaching(x, y, np.flatnonzero(h > r), r, k) for x, y, h, k in ((a, b, ha, pairs[0]), (b, a, hb, pairs[1])))

    # No point can do better than its nearest partner or the diagonal.
    near = [np.full(len(a), np.inf), np.full(len(b), np.inf)]
    apart = lambda s: np.maximum(*(np.abs(a[s : s + 512, None, c] - b[None, :, c]) for c in (0, 1)))
    if len(b):
        for s in range(0, len(a), 512):
            d = apart(s)
            near[0][s : s + 512] = d.min(axis=1)
            near[1] = np.minimum(near[1], d.min(axis=0))
    low = max(float(np.minimum(h, n).max(initial=0)) for h, n in zip((ha, hb), near, strict=True))
    if fits(low):
        return low
    top = float(max(ha.max(initial=0), hb.max(initial=0)))
    step = max(low, top / 256) / 16
    high = min(low + step, top)
    while not fits(high):
        low, step = high, 2 * step
        high = min(low + step, top)
    values = [h[(h > low) & (h <= high)] for h in (ha, hb)]
    if len(b):
        for s in range(0, len(a), 512):
            d = apart(s)
            values.append(np.unique(d[(d > low) & (d <= high)]))
    values = np.unique(np.concatenate(values))
    first, last = 0, len(values) - 1
    while first < last:
        mid = (first + last) // 2
        if fits(float(values[mid])):
            last = mid
        else:
            first = mid + 1
    return float(values[first])


def spectral(d: np.ndarray, eigen: int = 50, scale: float = 0.5, normalized: bool = True) -> np.ndarray:
    """Distances between rows of the Laplacian's eigenvectors (the first left out) of a Gaussian similarity of distances."""
    d = np.array(d, float)
    top = d[np.isfinite(d)].max(initial=0.0)
    d[~np.isfinite(d)] = 1.5 * top
    spread = d.max() - d.min()
    sigma = scale * spread or 1.0
    w = np.exp(-(d**2) / (2 * sigma**2))
    np.fill_diagonal(w, 1.0)
    degree = w.sum(axis=1)
    lap = np.eye(len(d)) - w / np.sqrt(degree[:, None] * degree[None, :]) if normalized else np.diag(degree) - w
    _, v = np.linalg.eigh(lap)
    return distances(v[:, 1 : 1 + eigen])


def linkage(d: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) by Lance-Williams. Singletons are 0 to n - 1. The matrix must be square, symmetric and finite."""
    n = len(d)
    d = np.array(d, float)
    if d.ndim != 2 or d.shape[0] != d.shape[1] or not np.isfinite(d).all() or not np.allclose(d, d.T):
        raise ValueError("distances must be a square, symmetric matrix of finite numbers")
    if method == "ward.D2":
        d = d**2
    np.fill_diagonal(d, np.inf)
    size, name, alive, out = np.ones(n), list(range(n)), np.ones(n, bool), []
    for step in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        h, di, dj = d[i, j], d[i].copy(), d[j].copy()
        if method == "average":
            new = (size[i] * di + size[j] * dj) / (size[i] + size[j])
        elif method == "complete":
            new = np.maximum(di, dj)
        elif method == "single":
            new = np.minimum(di, dj)
        elif method == "mcquitty":
            new = (di + dj) / 2
        elif method == "ward.D2":
            new = ((size[i] + size) * di + (size[j] + size) * dj - size * h) / (size[i] + size[j] + size)
        elif method == "ward.D":
            new = ((size[i] + size) * di + (size[j] + size) * dj - size * h) / (size[i] + size[j] + size)
        elif method == "median":
            new = (di + dj) / 2 - h / 4
        elif method == "centroid":
            both = size[i] + size[j]
            new = (size[i] * di + size[j] * dj) / both - size[i] * size[j] * h / both**2
        else:
            raise ValueError(f"unknown linkage {method}")
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        out.append((name[i], name[j], float(np.sqrt(h) if method == "ward.D2" else h), int(size[i])))
        name[i] = n + step
    return out


def cut(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Labels 1 to k, numbered as they first appear."""
    if not 1 <= k <= n:
        raise ValueError("k must be from 1 to the number of items")
    members = {i: [i] for i in range(n)}
    for step, (a, b, _, _) in enumerate(merges[: n - k]):
        members[n + step] = members.pop(a) + members.pop(b)
    label = np.zeros(n, int)
    for c, group in enumerate(sorted(members.values(), key=min), 1):
        label[group] = c
    return label


def components(x: np.ndarray, k: int, scale: bool = True) -> np.ndarray:
    """Coordinates in the first k principal components of centred (and scaled) columns; constant columns are left out. Each
    component's largest weight is positive."""
    x = x - x.mean(axis=0)
    sd = x.std(axis=0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
    x = x[:, sd > 0] / (sd[sd > 0] if scale else 1)
    if not x.shape[1]:
        return np.zeros((len(x), k))
    u, s, v = np.linalg.svd(x, full_matrices=False)
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])
    out = (u * s * sign)[:, :k]
    return np.pad(out, ((0, 0), (0, k - out.shape[1])))


#: Differences of coordinates that are held at a time when neighbours are looked for: 8 bytes each.
DIFFERENCES = 2_000_000


def knn_distance(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each row to its k-th nearest other row (the last one if there are fewer), some rows at a time."""
    k, out = min(k, len(x) - 1), []
    step = max(1, DIFFERENCES // max(1, x.size))
    for i in range(0, len(x), step):
        d = np.sqrt(((x[i : i + step, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        d[np.arange(len(d)), np.arange(i, i + len(d))] = -1.0
        out.append(np.partition(d, k, axis=1)[:, k].copy())  # a view would keep the whole block
    return np.concatenate(out) if out else np.zeros(0)


def spectral_clusters(d: np.ndarray, k: int, seed: int = 5, rounds: int = 50) -> np.ndarray:
    """k-means on the normalised rows of the top k eigenvectors of a Gaussian similarity."""
    d = np.asarray(d, float)
    sigma = 0.5 * (d.max() - d.min()) or 1.0
    w = np.exp(-(d**2) / (2 * sigma**2))
    deg = w.sum(axis=1)
    _, v = np.linalg.eigh(w / np.sqrt(deg[:, None] * deg[None, :]))
    x = v[:, -k:]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = [x[0]]
    for _ in range(1, k):  # farthest first
        centre.append(x[np.min([((x - c) ** 2).sum(axis=1) for c in centre], axis=0).argmax()])
    c = np.array(centre)
    for _ in range(rounds):
        near = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
    order = {v: i + 1 for i, v in enumerate(dict.fromkeys(near.tolist()))}
    return np.array([order[v] for v in near.tolist()])


def ks_exact_p(d: float, n: int, m: int) -> float:
    """Exact two-sided p of D without ties: lattice paths that stay within D."""
    if d <= 0:
        return 1.0
    limit = d - 1e-9
    row = [0] * (m + 1)
    for i in range(n + 1):
        new = [0] * (m + 1)
        for j in range(m + 1):
            if abs(i / n - j / m) >= limit:
                continue
            new[j] = 1 if i == j == 0 else (row[j] if i else 0) + (new[j - 1] if j else 0)
        row = new
    return (comb(n + m, n) - row[m]) / comb(n + m, n)


def leaves(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Items in the order in which a tree shows them: of two branches the tighter one first (single items are tightest, of two the smaller
    number; of equal heights the earlier merge)."""
    parts, height = {i: [i] for i in range(n)}, {i: (-np.inf, i) for i in range(n)}
    for step, (a, b, h, _) in enumerate(merges):
        one, two = sorted((a, b), key=lambda x: height[x])
        parts[n + step] = parts.pop(one) + parts.pop(two)
        height[n + step] = (h, n + step)
    return [i for p in parts.values() for i in p]


def cophenetic(merges: list[tuple[int, int, float, int]], n: int) -> np.ndarray:
    """The height at which each two items first are in one branch."""
    out, members = np.zeros((n, n)), {i: np.array([i]) for i in range(n)}
    for step, (a, b, h, _) in enumerate(merges):
        one, two = members.pop(a), members.pop(b)
        out[np.ix_(one, two)] = h
        out[np.ix_(two, one)] = h
        members[n + step] = np.concatenate([one, two])
    return out
