"""Plain-Python versions of the operators, written from their contracts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(repeated)


def simhash(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def smallest(items, linked):
    """Each item's smallest reachable item, by trying all pairs."""
    union = Union()
    for i, a in enumerate(items):
        union.find(i)
        for j in range(i):
            if linked(a[1], items[j][1]):
                union.join(i, j)
    least = {}
    for i, (name, _) in enumerate(items):
        root = union.find(i)
        if name is not None:
            least[root] = min(name, least.get(root, name))
    return [least.get(union.find(i)) for i in range(len(items))]


def repeated_runs(docs, least_words):
    """Line positions in runs of `least_words` or more that stand at an earlier place; by trying every earlier start.

    docs: (id, text) in order. Returns {index: set of raw line numbers}.
    """
    seen, out = defaultdict(list), {}
    texts = []
    for k, (_, text) in enumerate(docs):
        lines = [(p, x.strip(" \t\n\v\f\r"), len(words(x))) for p, x in enumerate((text or "").split("\n")) if words(x)]
        texts.append(lines)
        cut = set()
        for i, (_, line, _) in enumerate(lines):
            for d, j in seen[line]:
                n, total = 0, 0
                while i + n < len(lines) and j + n < len(texts[d]) and lines[i + n][1] == texts[d][j + n][1]:
                    total += lines[i + n][2]
                    n += 1
                if total >= least_words:
                    cut |= {lines[i + m][0] for m in range(n)}
            seen[line].append((k, i))
        out[k] = cut
    return out


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and _luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def pii(text):
    """Base spans as (start, rank, end)."""
    return sorted((m.start(), rank, m.end()) for rank, (pattern, fits) in enumerate(_PII.values())
                  for m in re.finditer(pattern, text or "", re.ASCII) if fits(m.group()))


CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?: [^\s0-9@]*[0-9@]\S*)*", re.A)
LOOKS = {
    0: lambda v: "@" in v,
    1: lambda v: re.search(r"^[0-9]+(?:[.:,][0-9]+){2,}$", v),
    2: lambda v: re.search(r"^[0-9][0-9 .-]*$", v) and 12 <= len(re.sub("[^0-9]", "", v)) <= 19,
    3: lambda v: re.search(r"^\(?[0-9][0-9 ()./-]*$", v) and 7 <= len(re.sub("[^0-9]", "", v)) <= 15,
    4: lambda v: re.search(r"^[A-Za-z0-9_+/=.-]{16,}$", v) and re.search("[0-9]", v) and re.search("[A-Za-z]", v),
}


def occurrences(text):
    """(start, end, value, patterns) of every candidate, without its outer marks."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    for n, (start, end) in enumerate(found):
        left = text[found[n - 1][1] if n else 0 : start][-60:].lower()
        right = text[end : found[n + 1][0] if n + 1 < len(found) else len(text)][:60].lower()
        word, two = re.search(r"(\S+)\s*$", left, re.A), re.search(r"(\S+\s+\S+)\s*$", left, re.A)
        after = re.search(r"^\s*(\S+)", right, re.A)
        patterns = {"2 " + re.sub(r"\s+", " ", two[1], flags=re.A)} if two else set()
        if word:
            patterns |= {"1 " + word[1]} | ({f"0 {word[1]} _ {after[1]}"} if after else set())
        front = re.match(r"[^A-Za-z0-9+(@]*", text[start:end])[0]
        value = re.sub(r"^[^A-Za-z0-9+(@]+|[^A-Za-z0-9)]+$", "", text[start:end])
        yield start + len(front), start + len(front) + len(value), value, patterns


def discovered(pairs, least_seeds=5, least=800):
    """For each text the spans (start, rank, end, value) that contexts add: the scores of patterns and values by plain rounds."""
    rows = [(n, *o) for n, (_, t) in enumerate(pairs) for o in occurrences(t or "")]
    at, stands = defaultdict(set), defaultdict(set)
    for _, _, _, value, patterns in rows:
        for p in patterns:
            at[p].add(value)
            stands[value].add(p)

    def seed(value, kind):
        if kind == 4:
            return bool(re.fullmatch("[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}", value))
        return any(r == kind for _, r, _ in pii(value))

    seeds = {v: [1000 * seed(v, k) for k in range(5)] for v in stands}
    scores, accepted = {v: list(s) for v, s in seeds.items()}, None
    while True:
        now = {}
        for p, values in at.items():
            for k in range(5):
                mean = sum(scores[v][k] for v in values) // len(values)
                if mean >= least and sum(seeds[v][k] > 0 for v in values) >= least_seeds:
                    now[p, k] = mean
        if now == accepted:
            break
        accepted = now
        for v, s in seeds.items():
            if not any(s):
                scores[v] = [max((now.get((p, k), 0) for p in stands[v]), default=0) if LOOKS[k](v) else 0 for k in range(5)]
    out = [set() for _ in pairs]
    for n, start, end, value, patterns in rows:
        if not any(s < end and e > start for s, _, e in pii(pairs[n][1])):
            out[n] |= {(start, k, end, value) for p in patterns for k in range(5) if (p, k) in accepted and LOOKS[k](value)}
    return out
