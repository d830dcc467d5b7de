"""Awkward documents, and plain Python versions of the operators."""

import hashlib
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, quality_score string, mix_tokens string, component_id string"


def rows(docs):
    return [(i, t, "en" if i is None or i % 3 else None, f"src{(i or 0) % 7}" if i != 5 else None, len(t or ""), "s", "t", "q", "m", "c") for i, t in docs]


def frame(spark, docs):
    return spark.createDataFrame(rows(docs), SCHEMA)


def awkward(seed=1, n=40):
    """Nulls, empty and long texts, repeats, near copies, odd characters and rows without an id."""
    rng = random.Random(seed)
    words = [rng.choice(["alpha", "Beta", "gämma", "de", "of", "THE", "x1", "É", "don't", "a.b", "naïve"]) + rng.choice(["", "", "s", "ly", ",", "."]) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    long = text(120)
    docs = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "One  TWO"), (6, text(3000)), (7, long), (8, long), (8, long), (None, long), (None, None), (9, "x" * 50_000), (10, "   a\u0085b"), (11, "İstanbul straße ǅ"), (12, "tail \n "), (13, "<|endoftext|> it's 123  456"), (14, "a\x0bb\x1cc d")]
    for i in range(n):
        w = long.split(" ")
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((100 + i, " ".join(w)))
        docs.append((200 + i, text(rng.randint(1, 60))))
    return docs


def shingles(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def near_duplicates(docs, pct, width):
    sets = [shingles(t, width) for _, t in docs]
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    ids = [i for i, _ in docs]
    for a in range(len(docs)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                top[y] = x
    return [(i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in zip(ids, sets)]


def windows(items, width):
    out = set()
    for item, text in items:
        w = ascii_words(text)
        if item is not None and w:
            out |= {(tuple(w[i : i + width]), str(item)) for i in range(max(1, len(w) - width + 1))}
    return out


def ascii_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, width):
    found = windows(items, width)
    out = []
    for i, t in docs:
        w, hit, ids = ascii_words(t), set(), set()
        for phrase, item in found:
            for a in range(len(w) - len(phrase) + 1):
                if tuple(w[a : a + len(phrase)]) == phrase:
                    hit |= set(range(a, a + len(phrase)))
                    ids.add(item)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


BASE = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def base_spans(text):
    out = [(m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(BASE) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return [(name, a, b) for a, _, name, b in sorted(out)]


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def key(row):
    return tuple((x is not None, x) for x in row)
