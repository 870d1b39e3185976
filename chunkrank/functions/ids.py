"""Column expressions over chunk ids of the form ``<document>_<position>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(part: Column, whole: Column) -> Column:
    value = part.try_cast("int")
    problem = F.concat(F.lit("chunk id without an integer position: "), whole)
    return F.when(value.isNull(), F.raise_error(problem)).otherwise(value)


def _two_parts(chunk_id: Column) -> Column:
    parts = F.split(chunk_id, "_")
    problem = F.concat(F.lit("chunk id must hold exactly one underscore: "), chunk_id)
    return F.when(F.size(parts) != 2, F.raise_error(problem)).otherwise(parts)


def document_of(chunk_id: Column) -> Column:
    """Document part of a well-formed chunk id; a malformed id fails the query."""
    return F.element_at(_two_parts(chunk_id), 1)


def number_of(chunk_id: Column) -> Column:
    """Integer position of a well-formed chunk id; a malformed id fails the query."""
    return _number(F.element_at(_two_parts(chunk_id), 2), chunk_id)


def document_of_list(chunk_ids: Column) -> Column:
    """Document of a label list: that of its first id. An empty list fails the query."""
    return document_of(F.element_at(chunk_ids, 1))


def numbers_of_list(chunk_ids: Column) -> Column:
    return F.transform(chunk_ids, lambda c: _number(F.try_element_at(F.split(c, "_"), F.lit(2)), c))


def parent_id(chunk_id: Column) -> Column:
    """Text before the first underscore; an id without one is its own parent."""
    return F.substring_index(chunk_id, "_", 1)


def position(chunk_id: Column) -> Column:
    """Text after the last underscore."""
    return F.split_part(chunk_id, F.lit("_"), F.lit(-1))


def well_formed(chunk_id: Column) -> Column:
    """Whether ``document_of`` and ``number_of`` would accept the id."""
    parts = F.split(chunk_id, "_")
    return (F.size(parts) == 2) & F.try_element_at(parts, F.lit(2)).try_cast("int").isNotNull()
