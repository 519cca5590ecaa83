import re

W4 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return W4.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items, window=10):
    win = {}
    for k, t in items:
        w = words(t)
        for i in range(len(w) - window + 1):
            win.setdefault(tuple(w[i:i + window]), set()).add(str(k))
        if 0 < len(w) < window:
            win.setdefault(tuple(w), set()).add(str(k))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for m in {len(x) for x in win}:
            for i in range(len(w) - m + 1):
                if found := win.get(tuple(w[i:i + m])):
                    hit |= set(range(i, i + m))
                    ids |= found
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def brute_links(docs, n=5, t=0.8):
    sets = {}
    for d, text in docs:
        w = words(text)
        sets[d] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    links, root = {d: 0 for d in sets}, {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            s = len(sets[a] & sets[b])
            if s and s >= t * (len(sets[a]) + len(sets[b]) - s) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in ids}
