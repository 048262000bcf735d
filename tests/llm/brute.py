"""Plain answers to compare with: no hashing, no blocks, one pass over everything."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, width=13):
    words = [(i, SPACED.findall(t or "")) for i, t in docs]
    least = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def contamination(docs, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(str(i))
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[key]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def shingles(text, n=5):
    w = SPACED.findall(lower(text))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(docs, percent=80):
    """doc_id -> (set size, component, links)"""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), links[i]) for i, s in sets}


def lm(docs, order=3, backoff=0.4):
    words = {i: SPACED.findall(lower(t)) for i, t in docs}
    grams = lambda w: Counter(tuple(w[j : j + k]) for k in range(1, order + 1) for j in range(len(w) - k + 1))
    whole = sum((grams(w) for w in words.values()), Counter())
    total = sum(map(len, words.values()))
    out = {}
    for i, w in words.items():
        own = grams(w)
        score, top = 0.0, 0
        for j in range(len(w)):
            value = max(whole[w[j],] - own[w[j],], 0.5) / max(total - len(w), 1)
            for k in range(2, order + 1):
                if j - k + 1 >= 0:
                    g = tuple(w[j - k + 1 : j + 1])
                    n, before = whole[g] - own[g], whole[g[:-1]] - own[g[:-1]]
                    value = n / max(before, n) if n > 0 else value * backoff
                    top += k == order and n > 0
            score += math.log(value)
        out[i] = (len(w), score, top)
    return out


def toxicity_model(texts, discount, least, stem_discount, least_stem, stems=(8, 6, 4)):
    """texts: (text, class). Gives p(word, class) and s(word); the word None under a stem is its place for other words."""
    counts = [Counter(), Counter()]
    for text, c in set(texts):
        counts[c].update(set(ALNUM.findall(lower(text))))
    seen = set(counts[0]) | set(counts[1])
    mass = {w: counts[0][w] + counts[1][w] + 0.5 for w in seen}
    nodes = {(n, w[:n]) for w in seen for n in stems if len(w) > n}
    leaves = [(w, m) for w, m in mass.items()] + [((n, s), 0.5) for n, s in nodes] + [((0, ""), 0.5)]
    total = sum(m for _, m in leaves)
    own = lambda leaf, n: (leaf[:n] if len(leaf) > n else None) if isinstance(leaf, str) else (leaf[1][:n] if leaf[0] >= n else None)
    under = {node: sum(m for leaf, m in leaves if own(leaf, node[0]) == node[1]) for node in nodes}

    def leaf_of(word):
        if word in seen:
            return word
        return next(((n, word[:n]) for n in stems if len(word) > n and (n, word[:n]) in nodes), (0, ""))

    def p(leaf, c):
        words = counts[c]
        kept = {w: k - discount for w, k in words.items() if k >= least}
        out, left = kept.get(leaf, 0) / sum(words.values()), 1 - sum(kept.values()) / sum(words.values())
        s = dict(leaves)[leaf] / total
        for n in stems:
            types = Counter(w[:n] for w in words if len(w) > n)
            whole = max(sum(types.values()), 1)
            kept = {k: v - stem_discount for k, v in types.items() if v >= least_stem}
            stem = own(leaf, n)
            if stem in kept:
                out += left * kept[stem] / whole * s / (under[n, stem] / total)
            left *= 1 - sum(kept.values()) / whole
        return out + left * s

    return p, leaf_of, [leaf for leaf, _ in leaves]


def toxicity_pairs(texts, p, leaf_of, discount, least):
    """p(word, class, word before or None), backing off to ``p``."""
    counts = [Counter(), Counter()]
    for text, c in set(texts):
        w = ALNUM.findall(lower(text))
        counts[c].update(set(zip(w, w[1:], strict=False)))

    def after(word, c, before):
        own = {w: n for (v, w), n in counts[c].items() if v == before}
        kept = {w: n - discount for w, n in own.items() if n >= least}
        whole = max(sum(own.values()), 1)
        return kept.get(word, 0) / whole + (1 - sum(kept.values()) / whole) * p(leaf_of(word), c)

    return after


def toxicity_features(text, after, telling=(1, 3, 8, 20)):
    w = ALNUM.findall(lower(text))
    x = sorted((math.log(after(b, 1, a) / after(b, 0, a)) for a, b in zip([None, *w], w, strict=False)), reverse=True)
    return [sum(x) / len(x), *(sum(x[:k]) / k for k in telling)] if x else [0.0] * (1 + len(telling))


def i_match(docs, low, high, levels, telling):
    """doc_id -> fingerprint, edited fingerprint, near_edited, near_next; ids are whole and differ."""
    import xxhash

    of_word = lambda w: xxhash.xxh64(w.encode(), seed=42).intdigest()

    def of_terms(terms):
        h = 42
        for t in sorted(terms, key=lambda t: t - (1 << 64) if t >> 63 else t):
            h = xxhash.xxh64(t.to_bytes(8, "little"), seed=h).intdigest()
        return h

    def terms(text):
        return {of_word(w) for w in ALNUM.findall(text.lower())}

    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    df = Counter(t for _, text in order for t in terms(text))
    lexicon = {t for t, n in df.items() if max(2, low * len(order)) <= n <= max(2, high * len(order))}

    def cells(text):
        own, out, shift = terms(text) & lexicon, [], 0
        for many, parts in levels:
            out.append([{t for t in own if (t >> shift) % parts == k} for k in range(many)])
            shift += parts.bit_length() - 1
        return out

    def shown(levels_):
        return ".".join(format(of_terms(c) & 0xFFFFFFFF, "08X") if c else "-" for level in levels_ for c in level)

    def like(a, b, x, y):
        if x == y and any(c for level in x for c in level):
            return 1.0
        for k in reversed(range(len(levels))):
            told = [(p, q) for p, q in zip(x[k], y[k], strict=True) if p or q]
            if len(told) >= telling or (k == 0 and told):
                return sum(p == q for p, q in told) / len(told)
        return float(terms(a) == terms(b))

    out = {}
    for k, (i, text) in enumerate(order):
        following, third = order[(k + 1) % len(order)][1], len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        x, y, z = cells(text), cells(edited), cells(following)
        out[i] = (shown(x), shown(y), like(text, edited, x, y), like(text, following, x, z))
    return out


def rank_order(texts, labelled, size):
    """labelled: (text, lang). For each text: the language whose most frequent n-grams are least out of place, and 1 - distance / worst."""

    def ranked(many):
        n = Counter()
        for text in many:
            letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
            for word in letters.split():
                # an edge is a code above all others; a lone edge is no n-gram
                marked = [0x110000, *map(ord, word), 0x110000]
                n.update((c,) for c in marked[1:-1])
                n.update(zip(marked, marked[1:], strict=False))
                n.update(zip(marked, marked[1:], marked[2:], strict=False))
        code = lambda g: sum(c << 21 * k for k, c in enumerate(reversed(g)))
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))[:size]]

    by = defaultdict(list)
    for text, lang in labelled:
        by[lang].append(text)
    profiles = {lang: {g: k for k, g in enumerate(ranked(own))} for lang, own in sorted(by.items())}
    out = []
    for text in texts:
        own = ranked([text])
        if not own:
            out.append(("und", 0.0))
            continue
        apart = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: apart[lang])
        out.append((best, 1 - apart[best] / (size * len(own))))
    return out


def line_dedup(docs, least_chars=20, least_docs=3):
    """``(id, lines, dropped, kept text)`` for each row of ``(id, text)``; a null id is the smallest."""
    order = lambda i: (i is not None, i or 0)
    lines = [(i, (t or "").split("\n")) for i, t in docs]
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, ls in lines:
        for line in ls:
            holders[key(line)].add(i)
    gone = lambda i, line: len(key(line)) >= least_chars and len(h := holders[key(line)]) >= least_docs and i != max(h, key=order)
    return [(i, len(ls), sum(gone(i, x) for x in ls), "\n".join(x for x in ls if not gone(i, x))) for i, ls in lines]


def divergence(docs, least_docs=3, most_terms=200):
    """All of ``(lang, source, part, item, value, rank)`` for rows ``(text, lang, source)``, term by term."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [(term.findall(lower(t)), lang or "", source or "") for t, lang, source in docs]
    groups = sorted({(lang, source) for _, lang, source in rows})
    out = []
    for lang in {lang for lang, _ in groups}:
        seen = Counter(w for words, own, _ in rows if own == lang for w in set(words))
        kept = {w for w, n in seen.items() if n >= least_docs}
        count = {s: Counter() for own, s in groups if own == lang}
        for words, own, s in rows:
            if own == lang:
                count[s].update(w for w in words if w in kept)
        whole = sum(count.values(), Counter())
        chances = lambda c, size: {w: 1 + 10**9 * (c[w] + 1) // (size + len(kept)) for w in kept}
        p = {s: chances(c, sum(c.values())) for s, c in count.items()}
        q = chances(whole, sum(whole.values()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in p if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < most_terms]
    return out


def manifest(docs, fan=8):
    """``(id, leaf, subroot, root, proof, folded root, verified)`` of rows ``(doc_id, text, lang, source, n_chars)``."""
    hashed = lambda parts: sha("".join(parts))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: hashed(map(field, (d[0], d[3], d[2], d[4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([hashed(levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            first = i // fan * fan
            out.append((level[first:i], level[i + 1 : first + fan]))
            i //= fan
        return out

    by_lang = defaultdict(list)
    for d in docs:
        by_lang[d[2]].append(d)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for own in by_lang.values():
        own.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
    trees = [tree([leaf(d, d[1]) for d in by_lang[lang]]) for lang in order]
    top = tree([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, lang in enumerate(order):
        for i, d in enumerate(by_lang[lang]):
            path = siblings(trees[k], i) + siblings(top, k)
            changed = d[0] is not None and d[1] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
            folded = leaf(d, lower(d[1]) if changed else d[1])
            for left, right in path:
                folded = hashed([*left, folded, *right])
            out.append((d[0], trees[k][0][i], trees[k][-1][0], top[-1][0], hashed([x for left, right in path for x in left + right]), folded, folded == top[-1][0]))
    return out
