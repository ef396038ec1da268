"""Plain restatements of the operators, for small inputs."""

from collections import Counter


def shingles(text, size=5):
    w = (text or "").split()
    if len(w) >= size:
        return [tuple(w[i:i + size]) for i in range(len(w) - size + 1)]
    return [tuple(w)] if w else []


def near_classes(texts, similarity=0.8):
    """texts: {doc_id: text}; {doc_id: class_id} over all pairs."""
    sets = {i: set(shingles(t)) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for own in holders.values() for k, b in enumerate(own) for a in own[:k]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def items_held(texts, items, similarity=0.8):
    """{(doc_id, item_id): (start, similarity)} of the best window of as many words."""
    out = {}
    for item, text in items.items():
        want = Counter(shingles(text))
        n = len((text or "").split())
        for doc, body in texts.items():
            w = (body or "").split()
            if not n or not want.keys() & set(shingles(body, min(5, n))):
                continue
            for p in range(len(w) - n + 1):
                have = Counter(shingles(" ".join(w[p:p + n])))
                near = sum((want & have).values()) / sum((want | have).values())
                if near >= similarity and near > out.get((doc, item), (0, 0))[1]:
                    out[doc, item] = (p, near)
    return out


def without_repeats(texts, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)} by looking every string up."""
    seen, out = set(), {}
    for doc in sorted(texts):
        b = (texts[doc] or "").encode()
        gone, done = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                gone[max(i, done):i + length] = b"\1" * (i + length - max(i, done))
                done = i + length
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out
