"""Plain versions of the pipeline's stages."""

from quire.llm.wordscan import words_of


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def duplicates_left(rows):
    last = {}
    for i, t in rows:
        k = lower_az(t)
        last[k] = max(i, last.get(k, i))
    return set(last.values())


def classes(rows):
    sets, groups = {}, []
    for i, t in rows:
        w = words_of(t or "")
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for i in sets:
        linked = [g for g in groups if any(sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in g)]
        groups = [g for g in groups if g not in linked] + [{i}.union(*linked)]
    return groups


def is_contaminated(text, items):
    wins = set()
    for t in items:
        w = words_of(t or "")
        wins |= {tuple(w[k:k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    w, hit = words_of(text or ""), set()
    for k in {len(x) for x in wins}:
        for a in range(len(w) - k + 1):
            if tuple(w[a:a + k]) in wins:
                hit |= set(range(a, a + k))
    return len(hit) > 0 and 20 * len(hit) >= len(w)
