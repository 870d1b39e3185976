"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut before every run of word marks: no piece of the vocabulary holds a mark after another
character (checked on loading), so no merge crosses a cut. Within a segment, an agenda ordered by
score, then by place, holds the adjacent symbol pairs that form a piece; the best pair merges and
its new neighbours enter the agenda. Symbols outside the vocabulary fall back to bytes. Segments
repeat, so every worker remembers those it has met until there are too many. Each segment is compared with the sentencepiece
library, ids and decoded text, in the Arrow batch that first brings it; ``check="texts"`` compares
every whole text as well, at some three times the cost. The decoded text of a document is made from its
own ids.

Defined cases: null texts are empty and have no ids; repeated rows are encoded alone; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkrank.llm.tables import map_batches

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")

#: Segments that a worker remembers before it starts anew (some 250 bytes each).
REMEMBERED = 700_000
#: Longer segments and stretches are forgotten at once.
LONGEST_REMEMBERED = 64
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1_000_000


class MismatchError(ValueError):
    """The library encodes or decodes a text differently."""


class Codec:
    """One vocabulary: merges, byte fallback, and the segments met so far."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        special = {i for i in range(len(self.pieces)) if self._is_special(i)}
        self.ids = {piece: i for i, piece in enumerate(self.pieces) if i not in special}
        scores = sorted({-self.library.get_score(i) for i in self.ids.values()})
        place = {score: r for r, score in enumerate(scores)}
        self.rank = {piece: place[-self.library.get_score(i)] for piece, i in self.ids.items()}
        self.inner = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        self.of_byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.library.is_byte(i)}
        self.decimals = {piece: str(i) for piece, i in self.ids.items()}
        self.byte_of = {i: bytes([b]) for b, i in self.of_byte.items()}
        # Text of an id as it is written; an ASCII byte is a character of its own.
        self.text_of = {str(i): piece.replace(MARK, " ") for piece, i in self.ids.items()}
        self.text_of |= {str(i): chr(b) for b, i in self.of_byte.items() if b < 0x80}
        if len(self.of_byte) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece crosses word marks")
        sample = " a  b½ﬁ\t "
        if self.library.normalize(sample) != MARK + sample.replace(" ", MARK):
            raise ValueError("the vocabulary normalises texts beyond word marks")
        self.known: dict[str, str] = {}
        self.known_stretches: dict[str, str] = {}

    def _is_special(self, i: int) -> bool:
        lib = self.library
        return lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)

    def merge(self, stretch: str) -> list[str]:
        """The pieces of a stretch, by the agenda of adjacent pairs.

        An entry is the pair's place in the order of scores and its left symbol in one number.
        """
        symbols = list(stretch)
        n = len(symbols)
        rank = self.rank
        pair = [rank.get(a + b, -1) for a, b in zip(symbols, symbols[1:])]
        pair.append(-1)
        agenda = [r << 32 | left for left, r in enumerate(pair) if r >= 0]
        if not agenda:
            return symbols
        before = list(range(-1, n - 1))
        after = [*range(1, n), -1]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            if pair[left] != entry >> 32:
                continue  # one of the two has merged meanwhile
            right = after[left]
            symbols[left] = merged = symbols[left] + symbols[right]
            symbols[right] = ""
            pair[right] = -1
            after[left] = beyond = after[right]
            pair[left] = r = -1 if beyond < 0 else rank.get(merged + symbols[beyond], -1)
            if r >= 0:
                heapq.heappush(agenda, r << 32 | left)
            if beyond >= 0:
                before[beyond] = left
            ahead = before[left]
            if ahead >= 0:
                pair[ahead] = r = rank.get(symbols[ahead] + merged, -1)
                if r >= 0:
                    heapq.heappush(agenda, r << 32 | ahead)
        return [s for s in symbols if s]

    def encode_segment(self, segment: str) -> str:
        """Ids of a segment; it is cut once more where two characters are never inside one piece."""
        inner = self.inner
        cuts = [i for i, (a, b) in enumerate(zip(segment, segment[1:]), 1) if a + b not in inner]
        if not cuts:
            return self._ids_of(self.merge(segment))
        out = []
        start = 0
        for end in (*cuts, len(segment)):
            stretch = segment[start:end]
            start = end
            ids = self.known_stretches.get(stretch)
            if ids is None:
                ids = self._ids_of(self.merge(stretch))
                if len(stretch) <= LONGEST_REMEMBERED:
                    self.known_stretches[stretch] = ids
            out.append(ids)
        return ",".join(out)

    def _ids_of(self, pieces: list[str]) -> str:
        decimals = self.decimals
        return ",".join([decimals[p] if p in decimals else self._bytes_of(p) for p in pieces])

    def _bytes_of(self, piece: str) -> str:
        return ",".join([str(self.of_byte[b]) for b in piece.encode()])

    def decode(self, ids: list[int]) -> str:
        """Text with word marks as spaces; adjacent byte pieces are read as UTF-8 together."""
        pieces = self.pieces
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([pieces[i] for i in ids]).replace(MARK, " ")
        out: list[str] = []
        pending = b""
        for i in ids:
            if i in self.byte_of:
                pending += self.byte_of[i]
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending = b""
            out.append(pieces[i])
        out.append(pending.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")

    def learn(self, names: list[str]) -> None:
        """Encode segments, decode their ids, and compare both with the library in one call each.

        A name is the segment without its first mark. Joined by spaces the names form a text of
        just these segments, as long as each holds more than marks; a segment of marks ends a text
        and is compared behind a letter. As the ids decode to the text, every segment decodes to itself.
        """
        blank = [name for name in names if not name.strip(MARK)]
        for name in blank:
            self.known[name] = self.encode_segment(MARK + name)
            together = f"{self.encode_segment(MARK + 'a')},{self.known[name]}"
            wanted = self.library.encode("a " + " " * len(name))
            if ",".join(map(str, wanted)) != together or self.decode(wanted)[1:] != "a " + " " * len(name):
                raise MismatchError("a segment of marks differs from the library's")
        names = [name for name in names if name.strip(MARK)]
        if not names:
            return
        encoded = [self.encode_segment(MARK + name) for name in names]
        text = " ".join(names).replace(MARK, " ")
        together = ",".join(encoded)
        wanted = self.library.encode(text)
        if ",".join(map(str, wanted)) != together:
            raise MismatchError("a segment's ids differ from the library's")
        if not self.decode(wanted)[1:] == self.library.decode(wanted) == text:
            raise MismatchError("a segment's decoded text differs from the library's")
        self.known.update(zip(names, encoded))

    def names(self, text: str) -> list[str]:
        names = text.split(" ")
        if "" in names or MARK in text:
            names = [s[1:] for s in SEGMENT.findall(MARK + text.replace(" ", MARK))]
        return names

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of every text as decimals joined by commas."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.known_stretches) > REMEMBERED // 2:
            self.known_stretches.clear()
        split = [self.names(text) if text else [] for text in texts]
        missing = set().union(*split).difference(self.known)
        if missing:
            self.learn(list(missing))
        get = self.known.__getitem__
        out = [",".join(map(get, names)) for names in split]
        for name in missing:
            if len(name) > LONGEST_REMEMBERED:
                del self.known[name]
        return out

    def decoded_ids(self, ids: str) -> str:
        """The text of ids written as decimals, without the space of the first mark."""
        names = ids.split(",") if ids else []
        try:
            return "".join(map(self.text_of.__getitem__, names))[1:]
        except KeyError:  # bytes of longer characters
            return self.decode([int(name) for name in names])[1:]

    def decoded(self, text: str) -> str:
        """What the ids of a text decode to."""
        return self.decoded_ids(self.encode([text])[0])


@cache
def codec(model: str) -> Codec:
    return Codec(model)


def _groups(values: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for value in values:
        group.append(value)
        size += len(value)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encode(column: pa.Array, model: str, check: str) -> Iterator[tuple[str, str]]:
    """(ids, decoded text) of every text of a batch."""
    own = codec(model)
    for group in _groups([v.as_py() or "" for v in column]):
        for text, ids in zip(group, own.encode(group)):
            back = own.decoded_ids(ids)
            if check == "texts":
                wanted = own.library.encode(text)
                if ",".join(map(str, wanted)) != ids or own.library.decode(wanted) != back:
                    raise MismatchError("a text's ids or decoded text differ from the library's")
            yield ids, back


def _rows(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def encoded(
    documents: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", check: str = "segments"
) -> DataFrame:
    """doc_id, ids (decimals joined by commas) and decoded text of every document.

    ``model`` is a path that every executor can open.
    """
    rows = _rows(documents, doc_id, text)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [*_encode(batch.column("text"), model, check)]
        arrays = [pa.array([x[i] for x in out], pa.string()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "ids", "decoded"])

    schema = rows.select("doc_id").schema.add("ids", "string").add("decoded", "string")
    return map_batches(rows, encode, schema)


def digests(
    documents: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", check: str = "segments"
) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of ids and decoded text, made where these arise."""
    rows = _rows(documents, doc_id, text)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, of_ids, of_text = [], [], []
        for ids, back in _encode(batch.column("text"), model, check):
            counts.append(ids.count(",") + 1 if ids else 0)
            of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
            of_text.append(hashlib.sha256(back.encode()).hexdigest())
        arrays = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    schema = rows.select("doc_id").schema.add("n_tokens", "long")
    return map_batches(rows, encode, schema.add("ids_sha256", "string").add("decoded_sha256", "string"))
