"""Text to vectors: plug-in encoders run on Arrow batches, plus a checkable built-in one.

An encoder factory is called once per task; it returns a function from a list of texts to one vector
per text (or one matrix per text, one row per token). A factory that takes ``max_tokens`` or
``extended_context`` is told the limits and keeps them itself; for any other the texts are cut.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkrank.functions.text import prompted, tokens, truncated
from chunkrank.functions.vectors import l2_normalised, mean_vector
from chunkrank.operators.timing import Stopwatch, stretches, timed_for
from chunkrank.schema import one_per_dataset
from chunkrank.session import materialised

VECTOR = T.ArrayType(T.FloatType())
TOKEN_VECTORS = T.ArrayType(VECTOR)
HOT_CHUNKS = 100_000
SALTS = 64
EncoderFactory = Callable[[], Callable[[list[str]], Sequence]]


WORD = regex.compile(r"[\p{L}\p{N}]+")


def first_words(text: str, most: int) -> str:
    """The text up to the end of its ``most``-th word, as ``functions.text.tokens`` counts words."""
    for number, word in enumerate(WORD.finditer(text), 1):
        if number == most:
            return text[: word.end()]
    return text if most else ""


class Limits:
    """What the caller allows a model to read of a text, settled with its factory.

    ``max_tokens`` is the usual limit; ``extended_context`` lifts it.
    """

    def __init__(self, factory: EncoderFactory, max_tokens: int | None = None, extended_context: bool = False):
        wanted = {"max_tokens": max_tokens, "extended_context": extended_context}
        try:
            known = inspect.signature(factory).parameters
        except ValueError:
            known = {}
        every = any(p.kind is p.VAR_KEYWORD for p in known.values())
        self.factory = factory
        self.told = {name: value for name, value in wanted.items() if every or name in known}
        # A factory that does not know the limit is given texts that keep it.
        self.cut = None if extended_context or "max_tokens" in self.told else max_tokens

    def model(self) -> Callable:
        return self.factory(**self.told)

    def texts(self, texts: list[str]) -> list[str]:
        return texts if self.cut is None else [first_words(t, self.cut) for t in texts]


def encode(
    rows: DataFrame,
    factory: EncoderFactory,
    text_col: str = "text",
    prompt: str = "",
    batch_size: int = 128,
    token_level: bool = False,
    max_tokens: int | None = None,
    extended_context: bool = False,
    watch: Stopwatch | None = None,
) -> DataFrame:
    """Adds ``vector`` (or ``token_vectors``) computed by the plug-in; ``watch`` sums its seconds."""
    limits = Limits(factory, max_tokens, extended_context)
    name, kind = ("token_vectors", TOKEN_VECTORS) if token_level else ("vector", VECTOR)
    source = rows.withColumn("_text", prompted(F.col(text_col), prompt))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, kind)])
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = limits.model()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            for dataset, start, size in stretches(batch["dataset"], batch_size):
                part = batch.slice(start, size)
                with timed_for(watch, dataset):
                    texts = limits.texts(part["_text"].to_pylist())
                    out = [np.asarray(v, dtype=np.float32) for v in model(texts)]
                if token_level:
                    values = pa.array([list(m) for m in out], arrow.field(name).type)
                else:
                    values = pa.array(out, arrow.field(name).type)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], values], schema=arrow)

    return source.mapInArrow(run, schema)


def encode_in_context(
    corpus: DataFrame,
    factory: Callable[[], Callable[[list[list[str]]], Sequence]],
    text_col: str = "text",
    prompt: str = "",
    batch_size: int = 16,
    token_level: bool = False,
    max_tokens: int | None = None,
    extended_context: bool = False,
    watch: Stopwatch | None = None,
) -> DataFrame:
    """A contextual plug-in sees all chunks of a document together, in order.

    It receives up to ``batch_size`` documents (lists of chunk texts) at a time and returns one
    vector, or with ``token_level`` one token matrix, per chunk. A source without documents gives
    documents of one chunk. Documents stream past in order, so a task holds one batch of them, all of
    one data set. Limits hold for each chunk.
    """
    limits = Limits(factory, max_tokens, extended_context)
    name, kind = ("token_vectors", TOKEN_VECTORS) if token_level else ("vector", VECTOR)
    schema = T.StructType(
        [corpus.schema["dataset"], corpus.schema["chunk_id"], T.StructField(name, kind)]
    )
    placed = {"doc_id", "internal_id"} <= set(corpus.columns)
    alone = F.col("internal_id").isNull() if placed else F.lit(True)
    rows = corpus.select(
        "dataset",
        (F.when(alone, F.col("chunk_id")).otherwise(F.col("doc_id")) if placed else F.col("chunk_id")).alias("doc_id"),
        F.col("internal_id").alias("_place") if placed else F.lit(0).alias("_place"),
        "chunk_id",
        prompted(F.col(text_col), prompt).alias("_text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = limits.model()
        arrow = to_arrow_schema(schema)
        key, names, texts = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            with timed_for(watch, names[0][0]):
                documents = model([limits.texts(t) for t in texts])
                vectors = [np.asarray(v, dtype=np.float32) for document in documents for v in document]
            values = [v.tolist() for v in vectors]
            columns = [[n[0] for n in names], [n[1] for n in names], values]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
            names.clear()
            texts.clear()

        for batch in batches:
            for dataset, doc_id, chunk_id, text in zip(
                *[batch[c].to_pylist() for c in ("dataset", "doc_id", "chunk_id", "_text")]
            ):
                if (dataset, doc_id) != key:
                    if len(texts) == batch_size or key is not None and dataset != key[0]:
                        yield from flush()
                    key = (dataset, doc_id)
                    texts.append([])
                texts[-1].append(text)
                names.append((dataset, chunk_id))
        if texts:
            yield from flush()

    order = ("dataset", "doc_id", "_place", "chunk_id")
    return rows.repartition("dataset", "doc_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _bucket_and_sign(term: str, dim: int) -> tuple[int, float]:
    digest = hashlib.md5(term.encode()).hexdigest()
    return int(digest[:8], 16) % dim, 1.0 if digest[8] < "8" else -1.0


def hash_encode(
    rows: DataFrame, dim: int = 64, max_tokens: int | None = None, prompt: str = ""
) -> DataFrame:
    """Built-in encoder: a signed hashed bag of words of unit length (zero for no words)."""
    words = truncated(tokens(prompted(F.col("text"), prompt)), max_tokens)
    schema = T.StructType([*rows.schema.fields, T.StructField("_sums", T.ArrayType(T.DoubleType()))])
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            lists = batch["_words"]
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            coded = pc.list_flatten(lists).dictionary_encode()
            hashed = [_bucket_and_sign(t, dim) for t in coded.dictionary.to_pylist()]
            bucket = np.array([h[0] for h in hashed], dtype=np.int64)
            sign = np.array([h[1] for h in hashed])
            code = coded.indices.to_numpy(zero_copy_only=False)
            cell = np.repeat(np.arange(len(lists)), lengths) * dim + bucket[code]
            sums = np.bincount(cell, sign[code], minlength=len(lists) * dim)
            offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim)
            values = pa.ListArray.from_arrays(offsets, pa.array(sums))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], values], schema=arrow)

    return (
        rows.withColumn("_words", words)
        .mapInArrow(run, schema)
        .withColumn("vector", l2_normalised(F.col("_sums")))
        .drop("_sums")
    )


class HashedTokens:
    """Built-in token encoder: every word becomes a fixed vector of signs; a plug-in factory."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _vector(self, word: str) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(hashlib.sha512(word.encode()).digest(), dtype=np.uint8))
        return np.resize(bits, self.dim) * 2.0 - 1.0

    def __call__(self):
        def model(texts: list[str]) -> list[np.ndarray]:
            return [np.stack([self._vector(w) for w in text.lower().split() or [""]]) for text in texts]

        return model


def blend_with_document(vectors: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Built-in contextual encoding: chunk vector + alpha x mean vector of its document.

    Means combine before the shuffle. For the join back, documents of more than ``HOT_CHUNKS``
    chunks are spread over ``SALTS`` keys; only their ids are broadcast, and there is at most
    one such id per ``HOT_CHUNKS`` chunks of the corpus.
    """
    document = ["dataset", "doc_id"]
    means = materialised(
        vectors.groupBy(*document).agg(
            mean_vector(F.col("vector")).alias("_mean"), F.count("*").alias("_chunks")
        )
    )
    hot = F.col("_chunks") > HOT_CHUNKS
    hot_ids = F.broadcast(means.filter(hot).select(*document, F.lit(True).alias("_hot")))
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")
    salted = vectors.join(hot_ids, document, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))
    )
    last = F.when(hot, F.lit(SALTS - 1)).otherwise(F.lit(0))
    copies = means.select(*document, "_mean", F.explode(F.sequence(F.lit(0), last)).alias("_salt"))
    mixed = F.zip_with("vector", "_mean", lambda v, m: v.cast("double") + F.lit(float(alpha)) * m)
    return (
        salted.join(copies, [*document, "_salt"])
        .withColumn("vector", l2_normalised(mixed))
        .select(*vectors.columns)
    )


def pool_tokens(tokens_long: DataFrame) -> DataFrame:
    """Late chunking: the mean of the token vectors inside each chunk's span."""
    return tokens_long.groupBy("dataset", "chunk_id").agg(mean_vector(F.col("vector")).alias("vector"))


def late_chunks(tokens_long: DataFrame, spans: DataFrame, width: int = 512) -> DataFrame:
    """Late chunking of whole-document encodings: the mean of the tokens inside each chunk's span.

    ``tokens_long``: (dataset, doc_id, offset, vector), not tagged with any chunk. ``spans``:
    (dataset, doc_id, chunk_id, begin, end), end excluded; spans may overlap or leave tokens out. The
    range join goes by stretches of ``width`` offsets: a span is copied to each stretch it touches, so
    a very long document is many join keys. A chunk without tokens has no vector.
    """
    touched = F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))
    placed = spans.filter("begin < end").select("dataset", "doc_id", "chunk_id", "begin", "end", F.explode(touched).alias("_stretch"))
    inside = (F.col("offset") >= F.col("begin")) & (F.col("offset") < F.col("end"))
    tagged = (
        tokens_long.withColumn("_stretch", F.floor(F.col("offset") / width))
        .join(placed, ["dataset", "doc_id", "_stretch"])
        .filter(inside)
    )
    return pool_tokens(tagged)


def token_matrices(tokens_long: DataFrame, id_name: str) -> DataFrame:
    """Token rows (id, tok_pos, vector) as one matrix per text."""
    item = F.struct("tok_pos", "vector")
    return (
        tokens_long.groupBy("dataset", id_name)
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .select("dataset", id_name, F.col("_items.vector").alias("token_vectors"))
    )


def mark_padded(chunks: DataFrame) -> DataFrame:
    """Adds ``padded``: the chunk has fewer tokens than its data set's longest."""
    longest = chunks.groupBy("dataset").agg(F.max(F.size("token_vectors")).alias("_longest"))
    return (
        chunks.join(one_per_dataset(longest), "dataset")
        .withColumn("padded", F.size("token_vectors") < F.col("_longest"))
        .drop("_longest")
    )


def mean_over_documents(vectors: DataFrame) -> DataFrame:
    """One vector per parent document: the mean of its chunk vectors."""
    parent = F.substring_index("chunk_id", "_", 1)
    return vectors.groupBy("dataset", parent.alias("chunk_id")).agg(
        mean_vector(F.col("vector")).alias("vector")
    )
