"""Plain versions of the operators on lists, for small fixtures."""

import hashlib
import math
import re
import zlib

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminated(docs, items, size=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for key, text in items:
        w = find(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s:s + size]), set()).add("" if key is None else str(key))
    out = []
    for key, text in docs:
        w, hit, found = find(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                own = windows.get(tuple(w[s:s + n]))
                if own:
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((key, len(w), len(hit), len(found), sha(",".join(sorted(found))),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def deduplicated(docs, window=20):
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in docs]
    first = {}
    for k, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, (k, s)), (k, s))
    out = []
    for k, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (k, s):
                gone |= set(range(s, s + window))
        out.append((k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def components(docs, n=5, percent=80):
    sets = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[k] = ({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n
                   else {tuple(w)} if w else set())
    comp = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(comp[a], comp[b])
                    changed |= comp[a] != low or comp[b] != low
                    comp[a] = comp[b] = low
    return [(k, len(sets[k]), comp[k]) for k in sets]


def maglev(shards, slots):
    num = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    order = [[(num(f"{s}:offset") + j * (num(f"{s}:step") % (slots - 1) + 1)) % slots for j in range(slots)]
             for s in shards]
    table, turn = {}, 0
    while len(table) < slots:
        mine = order[turn % len(shards)]
        table[next(s for s in mine if s not in table)] = turn % len(shards)
        turn += 1
    return [table[s] for s in range(slots)]


def patterns(text):
    out = []
    digits = lambda t: re.sub("[^0-9]", "", t)
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = digits(m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d)))
                if not 13 <= len(d) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def _letter_words(text):
    """Letter runs of the lower-cased text."""
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def language_model(rows):
    """Counts of words (length 0) and n-grams per language; words have a blank on both sides."""
    counts = {n: {} for n in range(6)}
    for _, text, lang in rows:
        for w in _letter_words(text):
            for n in range(6):
                padded = f" {w} "
                for g in [w] if n == 0 else [padded[i:i + n] for i in range(len(padded) - n + 1)]:
                    own = counts[n].setdefault(g, {})
                    own[lang] = own.get(lang, 0) + 1
    return sorted({lang for _, _, lang in rows}), counts


def language(model, text):
    langs, counts = model
    words = _letter_words(text)
    if not words:
        return "und", 0.0
    total = {n: {lang: sum(c.get(lang, 0) for c in counts[n].values()) for lang in langs} for n in counts}

    def log(n, g, lang):
        return math.log((counts[n][g].get(lang, 0) + .5) / (total[n][lang] + .5 * (len(counts[n]) + 1)))

    sums, used = dict.fromkeys(langs, 0.0), 0
    for w in words:
        for n in (0, 5, 4, 3, 2, 1):
            padded = f" {w} "
            known = [g for g in ([w] if n == 0 else [padded[i:i + n] for i in range(len(padded) - n + 1)])
                     if g in counts[n]]
            if known:
                used += 1
                for lang in langs:
                    sums[lang] += sum(log(n, g, lang) for g in known) / len(known)
                break
    mean = {lang: s / max(1, used) * min(used, 8) for lang, s in sums.items()}
    best = max(langs, key=lambda lang: mean[lang])
    return best, 1 / sum(math.exp(m - mean[best]) for m in mean.values())
