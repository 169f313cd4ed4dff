"""Plain restatements of the operators' results over a few rows, and an awkward table."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string, taken string, digest string, th string, shard string, node string, queue string, spans string, n string, lines string"


def vocabulary(seed: int = 5, n: int = 400) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)]


def prose(r: random.Random, n: int) -> str:
    words = [r.choice(vocabulary()) for _ in range(n)]
    return "".join(w + ("\n" if i % 11 == 10 else " ") for i, w in enumerate(words)).strip()


def documents() -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, passages, nulls, empty and long texts, repeated rows."""
    r = random.Random(11)
    base = [prose(r, 60) for _ in range(12)]
    rows = [(i + 10, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[0].upper() if i % 2 else base[0], "en", "s0", None) for i in range(6)]
    for i in range(10):  # near copies: one word changed
        w = base[1].split(" ")
        w[r.randrange(len(w))] = f"edit{i}"
        rows.append((200 + i, " ".join(w), "fr", "s1", 1))
    passage = prose(r, 25)
    rows += [(300 + i, prose(r, 15) + "\n" + passage + "\n" + prose(r, 15), "es", None, 2) for i in range(4)]
    rows += [
        (400, None, "en", "s0", None), (401, "", None, "s1", 0), (402, " \t\n", "en", None, 3), (403, "one", "en", "s2", 3), (404, "One", "en", "s2", 3), (405, "two words", None, None, None),
        (406, "word " * 20_000, "en", "s0", 100_000), (407, "x" * 50_000, None, "s1", 50_000), (408, "123 456 789 " * 500, None, "s1", 1), (409, "!!! ... ???", "en", "s1", 2),
        (None, base[2], None, None, None), (None, None, None, None, None), (410, "mail a.b@example.org or +44 20 7946 0958, 10.0.0.1 card 4111 1111 1111 1111", "en", "s0", 1),
        (411, "日本語 текст ünïcödé 😀 <|endoftext|> don't it's", "ja", "s9", 5),
    ]
    rows += [rows[0], rows[0], (10, "another text under the same number", "en", "s0", 1)]
    return rows


def table(spark, rows: list[tuple] | None = None):
    """The rows with extra columns whose names clash with those that operators use."""
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(*r, *["x"] * 12) for r in rows], SCHEMA).repartition(3)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def exact(rows):
    groups: dict = {}
    for d, t, *_ in rows:
        groups.setdefault((t or "").translate(AZ), []).append(d)
    out = []
    for d, t, *_ in rows:
        key = (t or "").translate(AZ)
        ids = [x for x in groups[key] if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[key]), d == keep, hashlib.sha256(key.encode()).hexdigest()))
    return out


def substring(rows, width=13):
    first: dict = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            if d is not None:
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            f = first.get(tuple(w[i : i + width]))
            if d is not None and f is not None and f < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text, k):
    w = [x.translate(AZ) for x in words(text)]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(rows, k, percent):
    sets = [shingles(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, *_) in enumerate(rows)]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(s))) % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def pii_added(rows, rounds=3, confidence=0.8, support=5):
    """(spans of the four kinds that contexts add, credentials) of each row, by plain loops over the pattern-instance graph."""
    import math

    kinds = [*PII, "secret"]
    names = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key"
    secret = re.compile(rf"(?:AKIA|ASIA)[0-9A-Z]{{16}}|(?i:{names})[=:][^\x20\x09-\x0D]{{8,}}")
    tokens = []
    for n, (_, text, *_) in enumerate(rows):
        text, base = text or "", pii(text)
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        for i, m in enumerate(words):
            t = m.group()
            if len(t) < 4 or not re.search("[0-9@]", t):
                continue
            norm = lambda w: re.sub("[0-9]+", "0", w.lower())
            left, right = norm(words[i - 1].group()) if i else "^", norm(words[i + 1].group()) if i + 1 < len(words) else "$"
            shape = re.sub("[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", t))
            patterns = [f"L {left}", f"R {right}", f"B {left} {right}", f"LS {left} {shape}", f"RS {right} {shape}"]
            if key := re.match(r"([A-Za-z_.-]+)[=:]", t):
                patterns.append("K " + key[1].lower())
            seed = next((kinds.index(k) for k, s, e in base if s < m.end() and e > m.start()), 4 if secret.fullmatch(t) else None)
            tokens.append((n, m.start(), m.end(), re.sub(r"^[A-Za-z_.-]+[=:](?=.)", "", t).lower(), seed, patterns))
    edges: dict = {}
    for *_, inst, seed, patterns in tokens:
        for p in set(patterns):
            k, old = edges.get((p, inst), (0, None))
            edges[p, inst] = (k + 1, seed if old is None else old if seed is None else max(seed, old))
    total = Counter()
    for (p, _), (k, _) in edges.items():
        total[p] += k
    seeds = {(i, s): 1.0 for (_, i), (_, s) in edges.items() if s is not None}
    known = dict(seeds)
    for _ in range(rounds):
        hit, held = Counter(), Counter()
        for (p, i), (k, _) in edges.items():
            for kind in range(5):
                if (i, kind) in known:
                    hit[p, kind] += k * known[i, kind]
                    held[p, kind] += known[i, kind] >= confidence
        conf = {(p, kind): h / total[p] for (p, kind), h in hit.items()}
        good = {x: c for x, c in conf.items() if c >= confidence and held[x] >= support}
        reach: dict = {}
        for p, i in edges:
            for kind in range(5):
                if (p, kind) in good:
                    reach[i, kind] = reach.get((i, kind), 0.0) + math.log(max(1 - good[p, kind], 1e-6))
        known = dict(seeds)
        for x, r in reach.items():
            known[x] = max(known.get(x, 0.0), 1 - math.exp(r))
    others = {p for p, t in total.items() if t >= support and p[:2] in ("L ", "R ") and max([0.0, *(c for (q, _), c in conf.items() if q == p)]) < 1 - confidence}
    out: list = [(set(), set()) for _ in rows]
    for n, s, e, inst, seed, patterns in tokens:
        if seed == 4:
            out[n][1].add((4, s, e))
        claims = [(c, -kind) for p in patterns for kind in range(5) if (c := good.get((p, kind))) and known.get((inst, kind), 0) >= confidence]
        if seed is None and claims and not others & set(patterns):
            kind = -max(claims)[1]
            out[n][kind == 4].add((kind, s, e))
    return [(sorted(a), sorted(b)) for a, b in out]


def same(got, want) -> bool:
    """Equal as bags of rows."""
    return Counter(map(tuple, got)) == Counter(map(tuple, want))
