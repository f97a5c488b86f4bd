"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import Counter


def words(text):
    return (text or "").encode().split()


def near_duplicates(docs, n=5, percent=75):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) pairs, by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        k = min(n, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    shared = Counter()
    for ids in by.values():
        ids = sorted(ids)
        for x in range(len(ids)):
            for y in range(x):
                shared[ids[y], ids[x]] += 1
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring_dedup(texts, window=35):
    """[(n_words, n_removed, sha256 of what is left)]"""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def level(caps, weights, total):
    """Shares of total by weight, none above its cap, by halving the interval of the common level."""
    low, high = 0.0, max(c / w for c, w in zip(caps, weights))
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(c, mid * w) for c, w in zip(caps, weights)) < total:
            low = mid
        else:
            high = mid
    return [min(c, high * w) for c, w in zip(caps, weights)]


def fill(line, gap, copies):
    """Takes rows (size, .., row, times) in line while they fit, passing over those that don't; again from the start after each of these."""
    times = {r[-2]: r[-1] for r in line}
    while line := [r for r in line if times[r[-2]] and r[0] <= gap + 1e-6]:
        for r in line:
            if r[0] > gap + 1e-6:
                break
            copies[r[-2]] += 1
            times[r[-2]] -= 1
            gap -= r[0]
    return gap


def mix(rows, weights, repeats, slope):
    """{row: copies} of rows (row, source, size, u, key): Pareto ranks, taken one after another while they fit."""
    by = {}
    for r in rows:
        by.setdefault((r[1] is None, r[1] or ""), []).append(r)
    names = sorted(by)
    sizes = [sum(r[2] for r in by[n]) for n in names]
    targets = level([repeats * s for s in sizes], [weights[i % len(weights)] for i in range(len(names))], sum(sizes))
    copies = {r[0]: 0 for r in rows}
    for name, target in zip(names, targets):
        classes = {}
        for r in by[name]:
            if r[2]:
                classes.setdefault(r[2].bit_length() - 1, []).append(r)
        order = sorted(classes)
        masses = [sum(r[2] for r in classes[c]) for c in order]
        shares = level([repeats * m for m in masses], [m * (1 + slope * c) for c, m in zip(order, masses)], target)
        gap, ranked = target, []
        for c, mass, share in zip(order, masses, shares):
            whole = int(share / mass + 1e-6)
            part = max(share / mass - whole, 0.0)
            gap -= whole * mass
            for r in classes[c]:
                copies[r[0]] = whole
                if 1e-6 < part < 1:
                    ranked.append((r[3] / (1 - r[3]) / (part / (1 - part)), r[2], r[4], r[0]))
        gap = fill([(*r[1:], r[3], 1) for r in sorted(ranked)], gap, copies)
        every = sorted((r[3], r[2], r[4], r[0]) for c in order for r in classes[c])
        gap = fill([(r[1], r[2], r[3], r[3], repeats - copies[r[3]]) for r in every], gap, copies)
        beyond = sorted((r[2], r[3], r[4], r[0]) for c in order for r in classes[c] if copies[r[0]] < repeats and r[2] < 2 * gap)
        if beyond:
            copies[beyond[0][3]] += 1
    return copies


def propagate(pieces, quota, shards):
    """{(group, start): shard} of pieces {(group, start): n}: moves to where most of a group is, while shards have room."""
    at = {p: p[1] for p in pieces}
    while True:
        load = [sum(n for p, n in pieces.items() if at[p] == s) for s in range(shards)]
        asks = []
        for group in {g for g, _ in pieces}:
            mine = [p for p in pieces if p[0] == group]
            mass = {p: sum(pieces[q] for q in mine if at[q] == at[p]) for p in mine}
            ahead, parts = 0, {}
            for p in sorted(mine, key=lambda p: (-mass[p], at[p], p[1])):
                lead = parts.setdefault(ahead // max(1, quota // 2), p)
                ahead += pieces[p]
                if at[lead] != at[p]:
                    asks.append((at[lead], mass[lead], p))
        moved = False
        for shard in range(shards):
            room, before = quota - load[shard], 0
            mine = [(64 - len(bin(g)) + 2, p[0][0] % 64, -g, p) for s, g, p in asks if s == shard]
            for *_, p in sorted(mine):
                if before + pieces[p] <= room:
                    at[p], moved = shard, True
                before += pieces[p]
        if not moved:
            return at


def repetition(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares by n, line_share)"""
    w = [x.decode() for x in words(text)]
    chars = sum(map(len, w))
    lines, seen, dup, dup_chars = (text or "").split("\n"), set(), 0, 0
    for line in lines:
        if words(line):
            if line in seen:
                dup += 1
                dup_chars += sum(len(x.decode()) for x in words(line))
            seen.add(line)
    inside = {}
    for n in range(5, 11):
        runs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        counts = Counter(runs)
        inside[n] = {j for i, r in enumerate(runs) if counts[r] > 1 for j in range(i, i + n)}
    shares = {n: sum(len(w[j]) for j in at) / max(1, chars) for n, at in inside.items()}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), chars, symbols, dup, len(inside[8]), shares, dup_chars / max(1, chars)
