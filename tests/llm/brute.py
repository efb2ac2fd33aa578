"""The operators' contracts, word for word and slowly."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def suffix_dedup(docs, length=200):
    seen = Counter(t[i:i + length] for _, t in docs for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs):
    codes = [(i, fingerprint(t)) for i, t in docs]
    distinct = sorted({c for _, c in codes})
    root = {c: c for c in distinct}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for n, a in enumerate(distinct):
        for b in distinct[:n]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, c in codes:
        least[find(c)].append(i)
    return [(i, f"{c:016x}", min((x for x in least[find(c)] if x is not None), default=None)) for i, c in codes]


def spans_sha(found, kinds):
    return sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((s, kinds.index(k), e, k) for k, s, e in found)).encode())


def secrets(text):
    found = [("assign", *m.span()) for m in re.finditer(
        r"""(?:(?ia:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return found


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def personal(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
              sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))
    return (*counts, len(words) < 50 or 100 * len(inside) > 50 * len(words))


def targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return share | full
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def hard_negatives(rows):
    """rows: (id, vector, label), ids distinct."""
    kept = [(i, v, l) for i, v, l in rows if i is not None and l is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in kept]
    out = []
    for a, v, l in whole:
        if a % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), b, m) for b, w, m in whole if b != a)
            for p, b, _ in [x for x in scored if x[2] == l][:5]:
                fit = [x for x in scored if x[2] != l and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
                out += [(a, b, n, c, -p, -s) for n, (s, c, _) in enumerate(fit, 1)]
    return out


def item_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contaminated(docs, items, length=10):
    windows = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            windows[tuple(w[i:i + length])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit)))
    return out


def divergence(docs, top=200):
    """docs: (text, lang, source)."""
    docs = [(t or "", l or "", s or "") for t, l, s in docs]
    frequency, group, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered))
        frequency[lang].update(terms.keys())
        group[lang, source].update(terms)
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in frequency[lang].items() if n >= 3]
        sources = [s for g, s in groups if g == lang]

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 1000000000 * (counter[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(group[lang, s]) for s in sources}
        q = shares(sum((group[lang, s] for s in sources), Counter()))
        for s in sources:
            near = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, n) for n, (v, _, o) in enumerate(sorted(near), 1)]
            telling = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept
                       if group[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, n) for n, (v, _, t) in enumerate(sorted(telling)[:top], 1)]
    return out
