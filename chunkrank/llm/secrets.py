"""Secret scan: fixed patterns, and windows of high Shannon entropy.

Candidate strings are unbroken runs of key characters. A window slides over each run; the counts of
its characters change by one in and one out, and so does the sum of c*log2(c) that gives the
entropy. Each character class has its own threshold: hexadecimal runs cannot reach what base64 runs
reach. Windows over the threshold merge into spans. Runs that the allow-list explains as a whole (UUIDs,
paths and host names, dictionary-like camel case, letters with or without a counter) are left out, unless
their letters look drawn rather than spelled. A date or time stamp at the
start of a run, and a placeholder between signs, explain only themselves: what they leave of the run is
scanned as runs of its own. What a pattern has found is cut out of a span, the rest of it stays.

Defined cases: a null text is empty and has no spans; repeated rows are scanned alone; an empty table
gives an empty result. Offsets count code points and ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkrank.llm.tables import map_batches, row_column

# The base patterns and the least lengths of what they must catch.
ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGN = 6
LEAST_ACCESS = 20

RUN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
DIGIT = re.compile(rb"[0-9]")
LETTERS = re.compile(rb"[A-Za-z]{12,}")
SIGNS = re.compile(rb"[+/_=-]")
CONSONANTS = re.compile(rb"[bcdfghjklmnpqrstvwxz]{6,}")
RAREST = (b"j", b"q", b"x", b"z")
WINDOW = 20


@dataclass(frozen=True)
class CharacterClass:
    """A set of characters and the entropy (bits a character) that its windows must exceed."""

    name: str
    characters: re.Pattern[bytes]
    threshold: float


# In order: the first class that holds all characters of a run applies. A window of 20 characters
# has at most 4.32 bits.
CLASSES = (
    CharacterClass("digits", re.compile(rb"[0-9]+"), math.inf),
    CharacterClass("hex", re.compile(rb"[0-9a-f]+|[0-9A-F]+"), 3.0),
    CharacterClass("lower", re.compile(rb"[a-z0-9]+"), 3.6),
    CharacterClass("upper", re.compile(rb"[A-Z0-9]+"), 3.6),
    CharacterClass("base64", re.compile(rb"[A-Za-z0-9+/_=-]+"), 3.8),
)

ALLOWED = (
    re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(rb"[A-Za-z]*+(?:[/_=+-][A-Za-z]*+)*+[0-9]{0,4}"),  # words joined by signs, with a counter
    re.compile(rb"(?:[/_=+-]|[A-Z]?[a-z]{4,}+|[0-9]{1,6}+)++"),  # paths, camel case with numbers
)

# Parts of runs that explain themselves and nothing beside them.
DATE = re.compile(
    rb"(?:19|20)[0-9]{2}(-?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])"
    rb"(?:[T_-]?(?:[01][0-9]|2[0-3])-?[0-5][0-9](?:-?[0-5][0-9][0-9]{0,9})?Z?)?(?![A-Za-z0-9])"
)
PLACEHOLDER = re.compile(
    rb"(?i)(?<![A-Za-z0-9])"
    rb"(?:example|placeholder|changeme|x{4,}|0{4,}|0?1234567(?:8(?:90?)?)?|abcdef(?:g(?:h(?:ij?)?)?)?)+(?![A-Za-z0-9])"
)


def high_entropy(run: bytes, threshold: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows of the run with more entropy than the threshold."""
    if len(run) < width or threshold == math.inf:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts = [0] * 256
    total = 0.0
    for c in run[:width]:
        total += weight[counts[c] + 1] - weight[counts[c]]
        counts[c] += 1
    most = (math.log2(width) - threshold) * width
    spans: list[tuple[int, int]] = []
    for end in range(width, len(run) + 1):
        if total < most - 1e-9:
            if spans and spans[-1][1] >= end - width:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - width, end))
        if end < len(run):
            gone, came = run[end - width], run[end]
            if gone != came:
                total += weight[counts[gone] - 1] - weight[counts[gone]]
                counts[gone] -= 1
                total += weight[counts[came] + 1] - weight[counts[came]]
                counts[came] += 1
    return spans


def random_letters(run: bytes) -> bool:
    """Whether a stretch of letters in the run looks drawn rather than spelled.

    Spelled words change case at their beginnings only, and have few consonants in a row and few of the
    rarest letters; drawn ones change case at every second letter, or have many of either.
    """
    for word in LETTERS.findall(run):
        changes = sum((a ^ b) >> 5 & 1 for a, b in zip(word, word[1:]))
        if 5 * changes >= 2 * len(word):
            return True
        if changes <= 2:
            lower = word.lower()
            rare = sum(map(lower.count, RAREST))
            if 9 * rare >= len(lower) or rare and CONSONANTS.search(lower):
                return True
    return False


def _explained(run: bytes) -> bool:
    words = not DIGIT.search(run) or any(p.fullmatch(run) for p in ALLOWED)
    return words and not random_letters(run)


def _parts(run: bytes) -> list[tuple[int, int]]:
    """What dates and placeholders leave of a run."""
    date = DATE.match(run)
    at = date.end() if date else 0
    parts = []
    for match in PLACEHOLDER.finditer(run, at):
        parts.append((at, match.start()))
        at = match.end()
    return [(a, b) for a, b in [*parts, (at, len(run))] if b - a >= WINDOW]


def _surprising(text: bytes) -> list[tuple[int, int]]:
    found = []
    for match in RUN.finditer(text):
        if _explained(match.group()):
            continue
        for first, last in _parts(match.group()):
            part = match.group()[first:last]
            if _explained(part):
                continue
            # Signs beside drawn letters do not make them base64.
            judged = SIGNS.sub(b"", part) if random_letters(part) else part
            threshold = next(c.threshold for c in CLASSES if c.characters.fullmatch(judged))
            at = match.start() + first
            found += [(at + a, at + b) for a, b in high_entropy(part, threshold)]
    return found


def _rest(text: bytes, a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the base spans, in order, leave of a span; words that lead to an assignment are explained."""
    rest = []
    for start, end, kind in base:
        if start < b and a < end:
            if a < start and not (kind == 0 and _explained(text[a:start])):
                rest.append((a, start))
            a = max(a, end)
    return [*rest, (a, b)] if a < b else rest


def spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, ordered; the base kinds, and what the entropy adds to them."""
    base = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    base += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base.sort()
    more = [(*x, 3) for a, b in _surprising(text) for x in _rest(text, a, b, base)]
    return sorted(base + more, key=lambda x: (x[0], x[2], x[1]))


def _in_code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Translate byte offsets by counting each stretch of the text once."""
    places = sorted({p for a, b, _ in found for p in (a, b)})
    at, count, points = 0, 0, {}
    for p in places:
        count += len(text[at:p].decode())
        at = points[p] = p
        points[p] = count
    return [(points[a], points[b], k) for a, b, k in found]


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], []]
    for text in batch.column("text").cast(pa.large_binary()):
        value = text.as_py() or b""
        found = spans(value)
        found = _in_code_points(value, found) if found else found
        for out, part in zip(columns, ("start", "end", "kind")):
            out.append([x[("start", "end", "kind").index(part)] for x in found])
    kinds = pa.array([[KINDS[k] for k in ks] for ks in columns[2]], pa.list_(pa.string()))
    at = [pa.array(c, pa.list_(pa.int64())) for c in columns[:2]]
    return pa.RecordBatch.from_arrays([batch.column("row"), kinds, *at], names=["row", "kinds", "starts", "ends"])


def scanned(documents: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of the document) and its spans: kinds, starts and ends as arrays."""
    rows = documents.select(row_column(documents).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = rows.select("row").schema
    for name, kind in (("kinds", T.StringType()), ("starts", T.LongType()), ("ends", T.LongType())):
        schema = schema.add(name, T.ArrayType(kind))
    return map_batches(rows, _scan, schema)


def _listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")


def summaries(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans, per document."""
    all_spans = F.arrays_zip("kinds", "starts", "ends")
    base = F.filter(all_spans, lambda s: s["kinds"] != KINDS[3])

    def count(kind: str) -> F.Column:
        return F.size(F.filter(F.col("kinds"), lambda k: k == kind)).cast("long")

    return scanned(documents).select(
        F.col(f"row.`{doc_id}`").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(all_spans).alias("spans"),
    )


MASK = "[SECRET]"


def masked(documents: DataFrame) -> DataFrame:
    """The documents with every span of their text replaced; ``n_chars`` follows the new text.

    Overlapping spans are replaced as one.
    """

    def replace(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column("text"):
            value = text.as_py()
            if value:
                raw = value.encode()
                pieces, end = [], 0
                for a, b, _ in spans(raw):
                    if a >= end:
                        pieces += [raw[end:a], MASK.encode()]
                    end = max(end, b)
                value = b"".join([*pieces, raw[end:]]).decode()
            out.append(value)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    rows = documents.select(row_column(documents).alias("row"), F.col("text").cast("string").alias("text"))
    done = map_batches(rows, replace, rows.schema)
    length = F.when(F.col("row.text").isNotNull(), F.char_length("text")).otherwise(F.col("row.n_chars"))
    changed = {"text": F.col("text"), "n_chars": length.cast("long").alias("n_chars")}
    return done.select(*[changed.get(c, F.col(f"row.`{c}`").alias(c)) for c in documents.columns])
