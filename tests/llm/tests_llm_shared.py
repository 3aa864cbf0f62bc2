"""Brute-force helpers that several tests use."""


def brute_components(rows, size, percent):
    """(doc_id, component) by comparing all pairs of rows."""
    sets = []
    for _, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        n = len(words)
        sets.append({tuple(words[i : i + size]) for i in range(max(n - size + 1, 1))} if n else set())
    parent = {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {(d, top(d)) for d, _ in rows}
