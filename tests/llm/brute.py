"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().lower().split()


def components(docs):
    """doc_id -> (shingles, component) from (doc_id, text)."""
    sets = {}
    for key, text in docs:
        w = words(text)
        sets[key] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def deduped(docs, min_words):
    """doc_id -> (text, lines, removed lines) from (doc_id, text)."""
    lines = {k: t.split("\n") for k, t in sorted(docs) if t is not None}
    out, seen = {}, defaultdict(list)
    for k, own in lines.items():
        gone = [False] * len(own)
        for i, line in enumerate(own):
            best = 0
            for e, j in seen[line]:
                n = 0
                while i + n < len(own) and j + n < len(lines[e]) and own[i + n] == lines[e][j + n]:
                    n += 1
                best = max(best, n)
            if sum(len(x.encode().split()) for x in own[i:i + best]) >= min_words and best:
                gone[i:i + best] = [True] * best
            seen[line].append((k, i))
        out[k] = ("\n".join(x for x, g in zip(own, gone) if not g), len(own), sum(gone))
    return out


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def contaminated(docs, items, window=10):
    """doc_id -> (words, hit words, items)."""
    found = defaultdict(set)
    for name, text in items:
        w = WORD.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found[n, tuple(w[i:i + n])].add(str(name))
    out = {}
    for key, text in docs:
        w = WORD.findall(lower(text))
        hit, names = [False] * len(w), set()
        for n in {n for n, _ in found}:
            for i in range(len(w) - n + 1):
                if (n, tuple(w[i:i + n])) in found:
                    names |= found[n, tuple(w[i:i + n])]
                    hit[i:i + n] = [True] * n
        out[key] = (len(w), sum(hit), sorted(names))
    return out


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            hit[i:i + 3] = [True] * 3
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": sum(hit)}


TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergences(docs, least=30, top=50):
    """Rows (lang, source, part, item, value, rank) from (lang, source, text)."""
    count, seen, groups = defaultdict(Counter), Counter(), set()
    for lang, source, text in docs:
        lang, source, found = lang or "", source or "", TERM.findall(lower(text))
        groups.add((lang, source))
        count[lang, source].update(found)
        seen.update((lang, w) for w in set(found))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for g, w in seen if g == lang and seen[g, w] >= least]
        sources = sorted({s for g, s in groups if g == lang})

        def shares(counts):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][w] - p[t][w]) for w in kept), t.encode(), "pair") for t in sources if t != s]
            raised = [(q[w] - p[s][w], w.encode(), "term") for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part in (sorted(pairs), sorted(raised)[:top]):
                out += [(lang, s, kind, item.decode(), -v, i) for i, (v, item, kind) in enumerate(part, 1)]
    return sorted(out)


def hard_negatives(rows, anchors, positives=5, negatives=5, low=80):
    """Rows (anchor, positive, rank, negative, positive score, negative score) from (key, label, integers)."""
    out = []
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    for key, label, vector in rows:
        if key not in anchors:
            continue
        scored = sorted((-dot(vector, v), k, own == label) for k, own, v in rows if k != key)
        for p, k, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and low * -p <= 100 * -x[0] <= 100 * -p]
            out += [(key, k, i, n, -p, -s) for i, (s, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)
