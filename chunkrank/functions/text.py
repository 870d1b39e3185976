"""Tokens, prompts and reproducible draws as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompts a sentence encoder was trained with.
QUERY_PROMPT = "search_query: "
DOCUMENT_PROMPT = "search_document: "

# Anything that is neither a letter nor a digit separates tokens.
SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column, sentinels: Sequence[str] = ()) -> Column:
    """Lower-cased words; ``sentinels`` stand in for a tokenizer's special tokens."""
    words = F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != "")
    if sentinels:
        return F.concat(words, F.array(*[F.lit(s) for s in sentinels]))
    return words


def truncated(token_array: Column, max_tokens: int | None) -> Column:
    return token_array if max_tokens is None else F.slice(token_array, 1, max_tokens)


def prompted(text: Column, prompt: str) -> Column:
    return F.concat(F.lit(prompt), text) if prompt else text


def prompted_by_dataset(text: Column, dataset: Column, prompts: Mapping[str, str]) -> Column:
    """Put the prompt of its data set before a text; data sets without one keep theirs."""
    some = {name: prompt for name, prompt in prompts.items() if prompt}
    if not some:
        return text
    pairs = F.create_map(*[F.lit(x) for pair in some.items() for x in pair])
    return F.concat(F.coalesce(pairs[dataset], F.lit("")), text)


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the given columns."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
