"""Brute-force versions of the training-data operators."""

import functools
import hashlib
import ipaddress
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[text or ""].append(doc_id)
    return {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}


def near(docs):
    sets = {}
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(UP))
        sets[doc_id] = {(a, b) for a, b in zip(w, w[1:])} if len(w) > 1 else {tuple(w)} if w else set()
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    common = defaultdict(int)
    for ids in index.values():
        for a, b in combinations(sorted(ids), 2):
            common[a, b] += 1
    for (a, b), i in common.items():
        if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def targets(sizes, cap=3):
    """Reshare by weight until none is above its cap."""
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sources if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def top_k(vectors, k=5):
    q = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i in q:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


# --- surrogates -----------------------------------------------------------------
def _pii_canonical(pii, kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "phone":
        d = re.sub("[^0-9]", "", m.replace("(0)", ""))
        return "1" + d if len(d) == 10 and not m.startswith("+") else d
    if kind in ("card", "ssn"):
        return digits
    if kind == "iban":
        return m.replace(" ", "")
    if kind == "secret":
        return regex.sub(pii._LEAD, "", m)
    if kind == "person":
        title = regex.match(pii._TITLE, m)[0]
        return ("f" if title.strip(". ") in pii.FEMALE else "m") + "\x1f" + m[len(title) :].lower()
    if kind == "ip" and ":" in m:
        return ":".join(f"{int(g, 16):x}" for g in ipaddress.IPv6Address(m).exploded.split(":"))
    return m.lower()


def _pii_fill(value, stream):
    out, i = [], 0
    for c in value:
        if c.isascii() and c.isalnum():
            n = int(stream[i * 2 % 126 : i * 2 % 126 + 2], 16)
            i += 1
            c = str(n % 10) if c.isdigit() else chr((65 if c.isupper() else 97) + n % 26)
        out.append(c)
    return "".join(out)


def _pii_place(shape, chars, sign="[0-9]"):
    chars = iter(chars)
    return re.sub(sign, lambda _: next(chars), shape)


def _pii_surrogate(pii, kind, m, canon, key, attempt):
    """(kept lead, replacement)."""
    h = hashlib.sha512("\x1f".join([key, kind, canon, str(attempt)]).encode()).hexdigest()
    number = lambda at, n: int(h[at : at + n], 16)
    pick = lambda options, n: options.split()[n % len(options.split())]
    digits = "".join(f"{number(15 * i, 15) % 10**12:012d}" for i in range(8))
    pattern = {"secret": pii._LEAD, "person": pii._TITLE}.get(kind)
    kept = (regex.match(pattern, m) or [""])[0] if pattern else ""
    value = m[len(kept) :]
    if attempt >= pii.MOST:
        return kept, f"{kind}-{h[:24]}"
    if kind == "email":
        return kept, f"u{h[:14]}@mail{number(19, 4) % 10}.example.{pick('com net org', number(29, 4))}"
    if kind == "ip":
        return kept, ":".join(h[4 * i : 4 * i + 4] for i in range(8)) if ":" in m else ".".join(str(number(6 * i, 6) % 254 + 1) for i in range(4))
    if kind == "card":
        body = digits[: len(canon) - 1]
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(body[::-1]))
        return kept, _pii_place(m, body + str(-total % 10))
    if kind == "phone":
        n = 1 if canon[0] in "17" else 2 if canon[:2] in pii.CODES_2 else 3
        own = digits[:24][24 - len(canon) + n :]
        local = not m.startswith("+") and len(re.sub("[^0-9]", "", m)) == 10
        return kept, _pii_place(m.replace("(0)", "(o)"), own if local else canon[:n] + own).replace("(o)", "(0)")
    if kind == "ssn":
        return kept, _pii_place(m, digits[:9])
    if kind == "iban":
        body = _pii_fill(canon[4:], h)
        rest = int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return kept, _pii_place(m, f"{canon[:2]}{98 - rest:02d}{body}", "[0-9A-Z]")
    if kind == "person":
        gender, name = canon.split("\x1f")
        script = "cyrillic" if regex.search(r"\p{IsCyrillic}", name) else "greek" if regex.search(r"\p{IsGreek}", name) else "latin"
        names = pii.NAMES[script, gender == "f"]
        family = "".join(pick(pii.SYLLABLES[script], number(8 + 6 * i, 6)) for i in range(5)).capitalize()
        given = [pick(names, number(0, 8)), pick(names, number(40, 8))]
        return kept, " ".join([*given[: name.count(" ")], family])
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        made = (h * (len(value) // 128 + 1))[: len(value)]
        return kept, made.upper() if re.search("[A-F]", value) else made
    if value.startswith(("AKIA", "ASIA")):
        return kept, value[:4] + _pii_fill(value[4:], h)
    return kept, _pii_fill(value, h)


def surrogates(pii, docs, key):
    """{doc_id: (text, number of mentions)}; collisions are derived again in rounds."""
    fixed, found, entities = regex.compile(pii.REGEX), {}, {}
    kinds = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}
    kind_of = lambda m: next((k for k, p in kinds.items() if p.fullmatch(m)), "person")
    for d, text in docs:
        people = {}
        for m in fixed.finditer(text or ""):
            if kind_of(m[0]) == "person" and " " in (name := regex.sub(pii._TITLE, "", m[0])):
                people.setdefault(name, _pii_canonical(pii, "person", m[0]))
        pattern = fixed
        if people:
            names = "|".join(map(re.escape, sorted(people, key=lambda n: (-len(n), n))))
            pattern = regex.compile(rf"{pii.REGEX}|(?<![\p{{L}}0-9])(?:{names})(?![\p{{L}}0-9'’-])")
        found[d] = []
        for m in pattern.finditer(text or ""):
            kind = kind_of(m[0])
            canon = people[m[0]] if m[0] in people else _pii_canonical(pii, kind, m[0])
            found[d].append((m.span(), kind, m[0], canon))
            entities[kind, canon] = min(entities.get((kind, canon), m[0]), m[0])
    attempts = dict.fromkeys(entities, 0)
    while True:
        made = defaultdict(list)
        for (kind, canon), m in entities.items():
            kept, new = _pii_surrogate(pii, kind, m, canon, key, attempts[kind, canon])
            form = canon.split("\x1f")[0] + "\x1f" + new.lower() if kind == "person" else _pii_canonical(pii, kind, kept + new)
            made[kind, form].append(canon)
        bad = [(k, c) for (k, form), canons in made.items() for c in canons if attempts[k, c] < pii.MOST and ((k, form) in entities or c != min(canons))]
        if not bad:
            break
        for e in bad:
            attempts[e] += 1
    out = {}
    for d, text in docs:
        new = text
        for (start, end), kind, m, canon in reversed(found[d]):
            new = new[:start] + "".join(_pii_surrogate(pii, kind, m, canon, key, attempts[kind, canon])) + new[end:]
        out[d] = (new, len(found[d]))
    return out


# --- language ID ----------------------------------------------------------------
def _letters(text):
    return [w for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split(" ") if w]


def languages(learn, texts, evidence, longest=4, vocabulary=20_000):
    """`learn`: (lang, text) pairs. {key: (lang, score)} of `texts`."""
    counts = defaultdict(Counter)
    for lang, text in learn:
        counts[lang].update(_letters(text))
    counts = {lang: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]) for lang, c in counts.items()}
    langs = sorted(counts)
    tables = [counts]
    for size in range(1, longest + 1):
        grams = {lang: Counter() for lang in langs}
        for lang in langs:
            for word, n in counts[lang].items():
                w = f"<{word}>"
                for i in range(len(w) - size + 1):
                    grams[lang][w[i : i + size]] += n
        tables.append(grams)
    known = [set().union(*t.values()) if langs else set() for t in tables]

    def log(size, key, lang):
        t = tables[size][lang]
        return math.log(t.get(key, 0) + 0.5) - math.log(sum(t.values()) + 0.5 * len(known[size]) + 1)

    log = functools.cache(log)

    @functools.cache
    def word_scores(word):
        if word in known[0]:
            return [log(0, word, lang) for lang in langs]
        w = f"<{word}>"
        for size in range(longest, 0, -1):
            parts = [g for i in range(len(w) - size + 1) if (g := w[i : i + size]) in known[size]]
            if parts:
                return [sum(log(size, g, lang) for g in parts) / len(parts) for lang in langs]
        return [0.0] * len(langs)

    out = {}
    for key, text in texts:
        words = _letters(text or "")
        if not words or not langs:
            out[key] = ("und", 0.0)
            continue
        sums = [sum(s) / len(words) * min(len(words), evidence) for s in zip(*map(word_scores, words))]
        best = max(range(len(langs)), key=lambda i: (sums[i], -i))
        out[key] = (langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums))
    return out


# --- co-training ----------------------------------------------------------------
def co_training(quality, docs, labels):
    """`docs`: (doc_id, text, metadata); `labels`: {doc_id: good}. {doc_id: scores}."""
    unit, half = quality.UNIT, quality.TEXT_DIM // 2
    feats = {}
    for d, text, meta in docs:
        tokens, c = (text or "").split(), Counter()
        for t in tokens:
            shape = t
            for pattern, mark in quality._SHAPES:
                shape = pattern.sub(mark, shape)
            c[zlib.crc32(t.lower().encode()) % half] += 1
            c[half + 1 + zlib.crc32(shape[:40].encode()) % (half - 1)] += 1
        c[half] = sum(a == b for a, b in zip(tokens, tokens[1:]))
        feats[d] = ({f: math.ceil(n * (unit / max(1, len(tokens)))) for f, n in c.items() if n}, quality.facts(meta))
    fold = {d for d in labels if d in feats and zlib.crc32(str(d).encode()) % 4 == 0}
    train = {d: y for d, y in labels.items() if d in feats and d not in fold}

    def fit(text_class, meta_class):
        t, m, n = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
        for d, c in text_class.items():
            t[c].update(feats[d][0])
        for d, c in meta_class.items():
            m[c].update(feats[d][1])
            n[c] += 1
        total, smooth = [sum(x.values()) for x in t], unit / 8
        lo_t = lambda f: (math.log(t[1][f] + smooth) - math.log(total[1] + smooth * 2 * half)) - (math.log(t[0][f] + smooth) - math.log(total[0] + smooth * 2 * half))
        lo_m = lambda f: (math.log(m[1][f] + 1) - math.log(n[1] + 2)) - (math.log(m[0][f] + 1) - math.log(n[0] + 2))
        raw = {d: (sum(s * lo_t(f) for f, s in x.items()) / unit, sum(map(lo_m, y))) for d, (x, y) in feats.items()}
        held = sorted(fold)
        y = np.array([labels[d] for d in held], float)
        platt = [quality.logistic(np.array([[raw[d][i]] for d in held]), y) for i in (0, 1)]
        cal = {d: [w[0] * r[i] + w[1] for i, w in enumerate(platt)] for d, r in raw.items()}
        return cal, quality.logistic(np.array([cal[d] for d in held]), y)

    sigmoid = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    cal, blend = fit(train, train)
    for _ in range(quality.ROUNDS):
        sure = [{d: int(p > 0.5) for d, c in cal.items() if d not in labels and ((p := sigmoid(c[i])) >= quality.SURE or 1 - p >= quality.SURE)} for i in (0, 1)]
        cal, blend = fit(train | sure[1], train | sure[0])
    return {d: (sigmoid(c[0]), sigmoid(c[1]), sigmoid(c[0] * blend[0] + c[1] * blend[1] + blend[2])) for d, c in cal.items()}
