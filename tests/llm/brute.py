"""Plain versions of the operators, for small inputs."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality_counts(text):
    found = words(text)
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    seen = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    again = set()
    for i in range(len(found) - 7):
        if seen[tuple(found[i : i + 8])] > 1:
            again.update(range(i, i + 8))
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(again),
    )


def quality_verdicts(rows, rules, gamma, least):
    """{doc_id: (counts, base_failed, kept)} of (doc_id, text, lang, source) rows."""
    counts = {r[0]: quality_counts(r[1]) for r in rows}
    cell = {r[0]: (r[2], r[3]) for r in rows}
    failed = {d: c[0] < 20 or 100 * c[4] > 30 * c[0] for d, c in counts.items()}

    def ratio(d, rule):
        n, chars, symbols, lines, _ = counts[d]
        return {"chars_per_word": chars, "symbols_per_word": symbols, "dup_lines_per_word": lines}[rule] / max(n, 1)

    def bucket(x):
        return max(0, math.ceil(math.log(x / 1e-9) / math.log(gamma))) if x > 0 else -1

    def middle(b):
        return 0.0 if b < 0 else 1e-9 * gamma**b * 2 / (1 + gamma)

    feeds = defaultdict(list)
    for d in counts:
        if not failed[d]:
            for key in (cell[d], cell[d][:1], ()):
                feeds[key].append(d)
    out = {}
    for d in counts:
        kept = not failed[d]
        if kept:
            key = next((k for k in (cell[d], cell[d][:1], ()) if len(feeds[k]) >= least), None)
            for rule in rules if key is not None else ():
                values = sorted(bucket(ratio(x, rule.name)) for x in feeds[key])
                low, mid, high = (middle(values[math.ceil(len(values) * q) - 1]) for q in (0.25, 0.5, 0.75))
                x = ratio(d, rule.name)
                if x > mid + max(rule.reach * (high - mid), rule.slack):
                    kept = False
                if rule.both_sides and x < mid - max(rule.reach * (mid - low), rule.slack):
                    kept = False
        out[d] = (counts[d], failed[d], kept)
    return out


def similarity(a, b, shingle=5):
    def bag(text):
        w = words(text)
        return Counter(tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else Counter()

    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    every = sum(x.values()) + sum(y.values()) - both
    return both / every if every else 0.0


def near_classes(texts, least=0.8):
    """{id: smallest id of its class}."""
    found = {i: i for i in texts}

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    ids = sorted(texts)
    size = {i: len(words(texts[i])) for i in ids}
    sets = {i: set(words(texts[i])) for i in ids}
    for n, b in enumerate(ids):
        for a in ids[:n]:
            if size[a] and size[b] and 0.6 < size[a] / size[b] < 1.7 and len(sets[a] & sets[b]) > len(sets[a]) / 3:
                if similarity(texts[a], texts[b]) >= least:
                    x, y = sorted((root(a), root(b)))
                    found[y] = x
    return {i: root(i) for i in ids}


def without_repeats(texts, least=20):
    """{id: kept words}, in the order of ids."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        keep = [True] * len(w)
        for at in range(len(w) - least + 1):
            window = tuple(w[at : at + least])
            if window in seen:
                keep[at : at + least] = [False] * least
            seen.add(window)
        out[i] = (len(w), [x for x, k in zip(w, keep) if k])
    return out


def secret_spans(text):
    """The base spans: (start, order, end, kind)."""
    key = "|".join("".join(f"[{c}{c.upper()}]" for c in k) for k in ("password", "passwd", "secret", "token"))
    key += "|[aA][pP][iI]_?[kK][eE][yY]"
    out = []
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def warc_digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
