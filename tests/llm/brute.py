"""Plain Python versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    words = WORD.findall(lower_ascii(text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(texts, width, percent):
    """{id: (set size, component)}"""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def quality_base(text):
    words = WORD.findall(text or "")
    lines = (text or "").split("\n")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        sum(WORD.search(x) is not None and x in lines[:i] for i, x in enumerate(lines)), len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def line_dedup(rows, width=3):
    """{id: (text, lines removed)} for (id, text) rows."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[i] = (None, 0)
            continue
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - width + 1):
            window = tuple(lines[k : k + width])
            if WORD.search("\n".join(window)):
                if window in seen:
                    gone |= set(range(k, k + width))
                seen.add(window)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def gear_chunks(data, gear, mask, least, most):
    """Chunks of bytes by the sequential rolling hash."""
    out, begin, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFF
        n = i + 1 - begin
        if (h & mask == 0 and n >= least) or n == most:
            out.append(data[begin : i + 1])
            begin = i + 1
    return out + ([data[begin:]] if begin < len(data) else [])


def secrets(text):
    kinds = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.I | re.A),
        ("access", r"AKIA[A-Z0-9]+", 0, 18, 0),
        ("hex", r"[0-9a-f]+", 0, 16, 0),
    )
    found = [(m.start(), n, m.end(), k) for n, (k, p, g, least, flags) in enumerate(kinds) for m in re.finditer(p, text or "", flags) if len(m[g]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def source_targets(sizes, weights=(5, 2, 1), most=3):
    """Resharing step by step until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def mixed(rows, weights=(5, 2, 1), most=3):
    """{row: (size, target, words before, passes)} of (id, text, source) rows with different ids."""
    import hashlib

    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sizes = {}
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] = sizes.get(s, 0) + n
    targets = source_targets(sizes, weights, most)
    out, done = {}, dict.fromkeys(sizes, 0)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    place = lambda r: md5(f"{'null' if r[0] is None else r[0]}/{'null' if r[1] is None else md5(r[1])}")
    for k in sorted(range(len(rows)), key=lambda k: place(rows[k])):
        s = rows[k][2]
        passes = [done[s] + size[k] / 2 + i * sizes[s] for i in range(most)]
        out[k] = (size[k], targets[s], [x for x in passes if x < targets[s]])
        done[s] += size[k]
    return out


def time_of(share, schedule, steps=60):
    """Bisection of the schedule's numeric integral."""
    def area(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            end = min(t, t1)
            if end > t0:
                w = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                total += (end - t0) * (w0 + w) / 2
        return total

    low, high, whole = 0.0, 1.0, area(1.0)
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if area(middle) < share * whole else (low, middle)
    return low


def shard(key, tree):
    """The least exponential draw at each level; the hash is the public XXH64 of key, then path."""
    import math

    import xxhash

    def weight(node):
        return sum(map(weight, node.values())) if isinstance(node, dict) else node

    path, node = (), tree
    while isinstance(node, dict):
        draws = {}
        for name, below in node.items():
            seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
            bits = xxhash.xxh64_intdigest("/".join(map(str, (*path, name))).encode(), seed=seed) >> 11
            draws[name] = -math.log((bits + 0.5) / 2**53) / weight(below)
        name = min(draws, key=draws.get)
        path, node = (*path, name), node[name]
    return path[-1]


def repeated_spans(rows, cut, least_span):
    """{(id, text, start, length, n_chunks, first ids, whole, short)} of (id, text) rows; ``cut`` makes chunks of bytes."""
    import xxhash  # only to order rows that share an id as the operator does

    def order(row):
        i, t = row
        return (i is not None, i or 0, xxhash.xxh64_intdigest((t or "").encode(), seed=42) ^ (1 << 63))

    first, out = {}, set()
    for i, text in sorted(set(rows), key=order):
        at, held, spans = 0, (text or "").encode(), []
        for chunk in cut(held):
            if chunk in first:
                if spans and spans[-1][1] == at:
                    spans[-1][1] += len(chunk)
                    spans[-1][2].append(first[chunk])
                else:
                    spans.append([at, at + len(chunk), [first[chunk]]])
            else:
                first[chunk] = i
            at += len(chunk)
        for a, b, ids in spans:
            names = tuple(sorted({x for x in ids if x is not None}))
            out.add((i, text, a, b - a, len(ids), names, a == 0 and b == len(held), b - a < least_span))
    return out
