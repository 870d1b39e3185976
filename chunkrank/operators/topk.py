"""Exact top-k chunks (and parents) of every query, without emitting the pairs.

Scoring everything against everything is the work itself, but only the best ``k`` per query
leave a task. Three physical forms give the same rows:

broadcast  The queries fit a fixed bound. They are sent to every task once and the corpus is
           scored where it is read: no corpus row is shuffled.
tiles      The queries do not fit. They are written once as files of bounded size, one a task, and the
           chunks as well; a task lets all chunks pass the queries it holds, so that what a query must
           reach rises over the whole corpus and k rows a query leave in all. No corpus row is shuffled.
           Without floors a task holds chunks instead and takes all files of queries past them.
grid       The tasks cannot open the shared folder by themselves. Queries and chunks are hashed into
           cells of bounded size; each query cell meets each chunk cell through an equi-join on the
           cell numbers, so no task sees more than one cell of either side, however skewed the keys.

The form is picked by reading at most one row more than the bound.

Reductions, all exact: a chunk among the best k overall is among the best k of its task; a
parent's maximum is reached in some task, and fewer than k parents beat it there if fewer
than k beat it overall. Ties are broken by id in both places, so the order is total.

Floors: the k-th score a query reaches on some of the tasks' chunks is a lower bound of its k-th score
on all of them. Where there are many tasks, a first pass scores one task in sixteen, and the tasks of
the second send only what reaches the floor: about 16 k rows a query instead of k from every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkrank.operators import tiles
from chunkrank.schema import one_per_dataset
from chunkrank.session import scan_tasks

CHUNK = "chunk"
PARENT = "parent"
SCORE_STEPS = 1e6  # scores are compared after rounding to 6 places

BROADCAST_QUERIES = 2_048  # a task keeps k rows and more of each
BROADCAST_ELEMENTS = 32_000_000  # numbers or tokens of the queries, 256 MB
QUERY_CELL = 8_192
CHUNK_CELL = 65_536
CELL_ELEMENTS = 32_000_000  # numbers or tokens in a cell, whatever its row count
BLOCK_CELLS = 1_000_000  # scores held at once by a task
FEWEST_ROWS = 128
ROUGH_SHARE = 16  # of a block's cells one in so many may need its score in full
FULL_BLOCKS = 8  # blocks that are made in full at once where more do
PIECE_BYTES = 8_000_000  # of the chunks that a task makes ready at once
STREAM_QUERIES = (1_024, 4_096)  # queries of a task that all chunks pass: the bounds of a tile
STREAM_BYTES = 32_000_000  # of the numbers or tokens in such a tile, 8 a number
STREAM_ROWS = 65_536  # chunks in a file that such tasks read
SHARE_ROWS = 65_536  # chunks that a task takes at least
MOST_ROWS = 4_000_000  # chunks that a task takes at most, about
TASKS_A_CORE = 4
RANK_ROWS = 250_000  # candidates that a ranking task holds, about: some 500 bytes each
MERGE_GROUP = 64  # tasks whose candidates are merged together before all meet
FLOOR_EVERY = 16  # one task in so many is scored first, for the floors
FLOOR_TASKS = 64  # with fewer tasks than this, floors cost more than they save
FLOORS = {CHUNK: "_floor", PARENT: "_parent_floor"}


def hidden_identical(steps: np.ndarray, query_ids: pa.Array, targets: pa.Array) -> None:
    """Take targets named as their query out of its scores."""
    at = pc.index_in(query_ids, value_set=targets)
    rows = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
    steps[rows, pc.drop_null(at).to_numpy(zero_copy_only=False)] = -np.inf


def _scores_below(steps: np.ndarray) -> np.ndarray:
    """Scores a little below those that round to ``steps``."""
    low = (steps - 1) / SCORE_STEPS
    return low - np.abs(low) * 1e-15


def few_nonzero(mask: np.ndarray) -> np.ndarray:
    """Where a long mask is true, ascending: eight at a time, as nearly all of them are false."""
    whole = len(mask) // 8 * 8
    eights = np.flatnonzero(mask[:whole].view(np.uint64))
    which, within = np.nonzero(mask[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[which] * 8 + within, whole + np.flatnonzero(mask[whole:])])


def by_query(query: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The order by query and score descending; rows that tie keep their order."""
    order = np.argsort(-steps, kind="stable")
    # Numbers of 16 bits are sorted by their digits.
    own = query[order]
    return order[np.argsort(own.astype(np.uint16) if own.max(initial=0) < 1 << 16 else own, kind="stable")]


def parents_of(targets: pa.Array) -> pa.DictionaryArray:
    return pc.list_element(pc.split_pattern(targets, "_", max_splits=1), 0).dictionary_encode()


def _repeats(rows: pa.Table) -> bool:
    """Whether a query has a target more than once."""
    coded = rows["target"].combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.sort(rows["q"].to_numpy() * np.int64(len(coded.dictionary)) + code)
    return bool((key[1:] == key[:-1]).any())


def pieces(batch: pa.Table, most_bytes: int) -> Iterator[pa.Table]:
    """Rows of a batch in slices of about so many bytes."""
    each = max(1, batch.num_rows * most_bytes // max(batch.nbytes, 1))
    for start in range(0, batch.num_rows, each):
        yield batch.slice(start, each)


class _Best:
    """Best targets per query seen by one task, at one level.

    What a query must reach rises as blocks go by: to the k-th of a block, and to the k-th of all rows held
    whenever they are cut back to k a query.
    """

    def __init__(self, queries: pa.Table, k: int, level: str, ignore_identical: bool, distinct: bool = False):
        query_ids = queries["query_id"].combine_chunks()
        self.query_ids = query_ids
        self.distinct = distinct or level == PARENT  # rows of one target are one
        self.least = np.full(len(query_ids), -np.inf)
        if FLOORS[level] in queries.column_names:
            floors = pc.fill_null(queries[FLOORS[level]], -np.inf).to_numpy()
            self.least = np.rint(floors * SCORE_STEPS)
        self.low = _scores_below(self.least)
        # Where k rows reach the least score: the smallest id among them that has just that score.
        self.full = np.zeros(len(query_ids), dtype=bool)
        self.last = np.full(len(query_ids), "", dtype=object)
        self.k = k
        self.level = level
        self.ignore_identical = ignore_identical
        self.parts: list[pa.Table] = []
        self.rows = 0
        self.pieces = 0

    def add(self, scores: np.ndarray, targets: pa.Array) -> None:
        """``targets`` come by id descending, so among equal scores the first columns win."""
        if self.distinct:
            coded = targets.dictionary_encode()
            if len(coded.dictionary) < len(targets):
                return self._add_grouped(scores, coded)
        reached = scores >= self.low[:, None]
        if scores.shape[1] > 2 * self.k and np.count_nonzero(reached) > 2 * self.k * len(scores):
            # Before the floors have risen most scores reach them: what the k-th of this block reaches is sorted only.
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            reached = scores >= np.maximum(self.low, _scores_below(np.rint(kth * SCORE_STEPS)))[:, None]
        cells = np.flatnonzero(reached)
        query, column = np.divmod(cells, max(scores.shape[1], 1))
        self._take(query, column, np.rint(scores.ravel()[cells] * SCORE_STEPS), targets)

    def add_parents(self, scores: np.ndarray, targets: pa.Array) -> None:
        """The same for the best of each parent's targets; only those that reach the floor are looked at."""
        self._add_grouped(scores, parents_of(targets))

    def add_cells(self, query: np.ndarray, column: np.ndarray, scores: np.ndarray, targets: pa.Array) -> None:
        """The same for some cells of a block, ascending, among which are all that reach the floor."""
        reached = scores >= self.low[query]
        query, column, scores = query[reached], column[reached], scores[reached]
        if not len(query):
            return
        if self.distinct:
            coded = parents_of(targets) if self.level == PARENT else targets.dictionary_encode()
            if self.level == PARENT or len(coded.dictionary) < len(targets):
                return self._take_grouped(query, column, scores, coded)
        self._take(query, column, np.rint(scores * SCORE_STEPS), targets)

    def _add_grouped(self, scores: np.ndarray, coded: pa.DictionaryArray) -> None:
        cells = np.flatnonzero(scores >= self.low[:, None])
        if len(cells):
            self._take_grouped(*np.divmod(cells, scores.shape[1]), scores.ravel()[cells], coded)

    def _take_grouped(self, query: np.ndarray, column: np.ndarray, value: np.ndarray, coded: pa.DictionaryArray) -> None:
        order = pc.array_sort_indices(coded.dictionary, order="descending").to_numpy()
        names = coded.dictionary.take(pa.array(order))
        number = np.argsort(order)[coded.indices.to_numpy(zero_copy_only=False)]
        key = query * len(names) + number[column]
        if (np.diff(key) < 0).any():
            sorted_by = np.argsort(key, kind="stable")
            key, value = key[sorted_by], value[sorted_by]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        query, column = np.divmod(key[starts], len(names))
        steps = np.rint(np.maximum.reduceat(value, starts) * SCORE_STEPS)
        if self.ignore_identical and self.level == PARENT:
            at = pc.fill_null(pc.index_in(self.query_ids, value_set=names), -1).to_numpy(zero_copy_only=False)
            steps[column == at[query]] = -np.inf
        self._take(query, column, steps, names)

    def _take(self, query: np.ndarray, column: np.ndarray, steps: np.ndarray, names: pa.Array) -> None:
        keep = (steps >= self.least[query]) & (steps > -np.inf)
        tied = np.flatnonzero(keep & self.full[query] & (steps == self.least[query]))
        if len(tied):
            asked = np.unique(query[tied])
            ascending = np.array(names.to_pylist()[::-1], dtype=object)
            larger = np.zeros(len(self.query_ids), dtype=np.int64)
            larger[asked] = len(names) - np.searchsorted(ascending, self.last[asked], side="right")
            keep[tied] = column[tied] < larger[query[tied]]
        query, column, steps = query[keep], column[keep], steps[keep]
        if not len(query):
            return
        counts = np.bincount(query, minlength=len(self.query_ids))
        if counts.max() >= self.k:
            order = by_query(query, steps)
            query, column, steps = query[order], column[order], steps[order]
            within = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
            kth = within == self.k - 1
            self._raise(query[kth], steps[kth])
            query, column, steps = (x[within < self.k] for x in (query, column, steps))
        self.parts.append(
            pa.table(
                {
                    "q": pa.array(query, pa.int32()),
                    "steps": pa.array(steps),
                    "target": names.take(pa.array(column)),
                }
            )
        )
        self.rows += len(query)
        self.pieces += 1
        if self.pieces > 1 and self.rows > 2 * len(self.query_ids) * self.k:
            self.shrink()

    def _raise(self, query: np.ndarray, steps: np.ndarray) -> None:
        higher = steps > self.least[query]
        query, steps = query[higher], steps[higher]
        self.least[query] = steps
        self.low[query] = _scores_below(steps)
        self.full[query] = False

    def shrink(self) -> None:
        """Keep k rows a query. Ids are compared for those that share the k-th score only."""
        rows = pa.concat_tables(self.parts).combine_chunks()
        if self.distinct and _repeats(rows):
            rows = rows.group_by(["q", "target"]).aggregate([("steps", "max")])
            rows = rows.rename_columns({"steps_max": "steps"})
        query, steps = rows["q"].to_numpy(), rows["steps"].to_numpy()
        order = by_query(query, steps)
        query, steps = query[order], steps[order]
        counts = np.bincount(query, minlength=len(self.query_ids))
        within = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
        last = within == self.k - 1
        kth = np.full(len(self.query_ids), -np.inf)
        kth[query[last]] = steps[last]
        sure = steps > kth[query]
        room = self.k - np.bincount(query[sure], minlength=len(self.query_ids))
        level = pa.array(order[steps == kth[query]])
        tied = rows.select(["q", "target"]).take(level).append_column("at", level)
        tied = tied.sort_by([("q", "ascending"), ("target", "descending")])
        of = tied["q"].to_numpy()
        counts = np.bincount(of, minlength=len(self.query_ids))
        within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        self._raise(query[last], steps[last])
        ends = np.flatnonzero((within == room[of] - 1) & (kth[of] == self.least[of]))
        self.full[of[ends]] = True
        self.last[of[ends]] = tied["target"].take(pa.array(ends)).to_pylist()
        kept = np.concatenate([order[sure], tied["at"].to_numpy()[within < room[of]]])
        self.parts = [rows.select(["q", "steps", "target"]).take(pa.array(kept)).combine_chunks()]
        self.rows = self.parts[0].num_rows
        self.pieces = 1

    def rows_out(self) -> pa.Table | None:
        if self.pieces > 1:
            self.shrink()
        return self.parts[0] if self.parts else None


class _Task:
    """Scores chunk batches of one key group against its queries."""

    def __init__(self, plan: "_Plan", key: tuple, queries: pa.Table, distinct: bool = False):
        self.plan = plan
        self.key = key
        self.count = len(queries)
        self.query_ids = queries["query_id"].combine_chunks()
        self.queries = plan.scorer.load(queries)
        self.levels = [_Best(queries, plan.k, CHUNK, plan.ignore_identical, distinct)] if plan.k else []
        self.parents = (
            _Best(queries, plan.parent_k, PARENT, plan.ignore_identical) if plan.parent_k else None
        )
        self.in_full = 0  # blocks to come of which all scores are made in full

    def feed(self, batch: pa.Table) -> None:
        """Chunks in pieces of bounded size, so that what is made of them is bounded too."""
        for piece in pieces(batch, PIECE_BYTES):
            self._score(piece.sort_by([("chunk_id", "descending")]))

    def _score(self, batch: pa.Table) -> None:
        ids = batch["chunk_id"].combine_chunks()
        chunks = self.plan.scorer.prepare(self.queries, batch)
        rows = max(FEWEST_ROWS, BLOCK_CELLS // max(self.count, self.plan.scorer.width(self.queries), 1))
        for start in range(0, len(ids), rows):
            stop = min(start + rows, len(ids))
            if self._score_reaching(chunks, start, stop, ids.slice(start, stop - start)):
                continue
            scores = self.plan.scorer.score(self.queries, chunks, start, stop)
            # One number that is not finite makes the sum so; a large sum alone is no fault.
            if not np.isfinite(scores.sum()) and not np.isfinite(scores).all():
                row, column = np.argwhere(~np.isfinite(scores))[0]
                raise ValueError(f"score of chunk {ids[start + int(column)]} is not a finite number")
            targets = ids.slice(start, stop - start)
            if self.plan.ignore_identical:
                hidden_identical(scores, self.query_ids, targets)
            for best in self.levels:
                best.add(scores, targets)
            if self.parents is not None:
                self.parents.add_parents(scores, targets)

    def _score_reaching(self, chunks, start: int, stop: int, targets: pa.Array) -> bool:
        """Score a block roughly, and in full only the cells that can reach what their query must reach.

        False where most can, as before the floors have risen: then nothing is done.
        """
        bests = [*self.levels, *([self.parents] if self.parents else [])]
        low = np.minimum.reduce([best.low for best in bests])
        self.in_full -= 1
        if self.in_full > 0 or np.isneginf(low).sum() * ROUGH_SHARE > len(low):
            return False
        rough = self.plan.scorer.rough(self.queries, chunks, start, stop)
        # A number that is not finite is for the scores in full to tell.
        if rough is None or not np.isfinite(rough.scores.sum()):
            return False
        # As float32 the floor itself is off by half a step.
        low = low - rough.slack - np.abs(low) * np.finfo(np.float32).eps
        reached = rough.scores >= low.astype(np.float32)[:, None]
        if np.count_nonzero(reached) * ROUGH_SHARE > reached.size:
            self.in_full = FULL_BLOCKS
            return False
        cells = few_nonzero(reached.ravel())
        scores = self.plan.scorer.settled(self.queries, rough, reached, cells)
        query, column = np.divmod(cells, stop - start)
        if self.plan.ignore_identical:
            at = pc.fill_null(pc.index_in(self.query_ids, value_set=targets), -1).to_numpy(zero_copy_only=False)
            scores[column == at[query]] = -np.inf
        for best in bests:
            best.add_cells(query, column, scores, targets)
        return True

    def results(self) -> Iterator[pa.RecordBatch]:
        for best in [*self.levels, *([self.parents] if self.parents else [])]:
            rows = best.rows_out()
            if rows is None or rows.num_rows == 0:
                continue
            n = rows.num_rows
            columns = [pa.repeat(pa.scalar(v, f.type), n) for v, f in zip(self.key, self.plan.arrow)]
            columns += [
                pa.repeat(pa.scalar(best.level, pa.string()), n),
                best.query_ids.take(rows["q"].combine_chunks()),
                rows["target"].combine_chunks(),
                pa.array(rows["steps"].to_numpy() / SCORE_STEPS),
            ]
            table = pa.Table.from_arrays(columns, schema=self.plan.arrow)
            yield from table.to_batches(max_chunksize=65_536)


class _Plan:
    def __init__(self, scorer, keys, key_fields, k, parent_k, ignore_identical):
        self.scorer = scorer
        self.keys = list(keys)
        self.k = k
        self.parent_k = parent_k
        self.ignore_identical = ignore_identical
        self.schema = T.StructType(
            [
                *key_fields,
                T.StructField("level", T.StringType()),
                T.StructField("query_id", T.StringType()),
                T.StructField("target_id", T.StringType()),
                T.StructField("score", T.DoubleType()),
            ]
        )
        self.arrow = to_arrow_schema(self.schema)

    def groups(self, table: pa.Table) -> dict[tuple, pa.Table]:
        """Split a batch by its key values."""
        seen = table.select(self.keys).group_by(self.keys).aggregate([]).to_pylist()
        if len(seen) == 1:
            return {tuple(seen[0][name] for name in self.keys): table}
        parts = {}
        for row in seen:
            mask = None
            for name in self.keys:
                same = pc.equal(table[name], pa.scalar(row[name], table.schema.field(name).type))
                mask = same if mask is None else pc.and_(mask, same)
            parts[tuple(row[name] for name in self.keys)] = table.filter(mask)
        return parts


def _skipped(every: int) -> bool:
    """Whether this task is left out of a pass over one task in ``every``."""
    return every > 1 and TaskContext.get().partitionId() % every != 0


def _broadcast_form(plan: _Plan, queries: pa.Table, chunks: DataFrame, every: int = 1) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(plan.groups(queries))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _skipped(every):
            return
        tasks: dict[tuple, _Task] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for key, rows in plan.groups(pa.Table.from_batches([batch])).items():
                if key not in shared.value:
                    continue
                if key not in tasks:
                    tasks[key] = _Task(plan, key, shared.value[key])
                tasks[key].feed(rows)
            # A batch of long texts is large: it goes before the next one comes.
            batch = rows = None
            pa.default_memory_pool().release_unused()
        for task in tasks.values():
            yield from task.results()

    return chunks.mapInArrow(score, plan.schema)


def _tile_form(plan: _Plan, queries: tiles.Tiles, chunks: DataFrame, chunk_cell: int) -> DataFrame:
    """Every task gathers chunks up to a cell and takes all tiles past it, one at a time."""
    files, columns = queries.files, queries.table.columns
    sized = chunks.withColumn("_elements", plan.scorer.elements())

    def scored(cell: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = plan.groups(pa.Table.from_batches(cell).drop_columns(["_elements"]))
        for file in files:
            for key, asked in plan.groups(tiles.load(file, columns)).items():
                if key in held:
                    task = _Task(plan, key, asked)
                    task.feed(held[key])
                    yield from task.results()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, elements = [], 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cell.append(batch)
            rows += batch.num_rows
            elements += pc.sum(batch["_elements"]).as_py() or 0
            if rows >= chunk_cell or elements >= CELL_ELEMENTS:
                yield from scored(cell)
                cell, rows, elements = [], 0, 0
        if cell:
            yield from scored(cell)

    return sized.mapInArrow(score, plan.schema)


def stream_shares(tiles_in_all: int, files: int, rows: int, wanted: int) -> int:
    """In how many shares the chunks pass a tile: enough for the cores, and that no task takes more than its most."""
    for_cores = min(rows // SHARE_ROWS, -(-wanted // max(tiles_in_all, 1)))
    return max(1, min(files, max(for_cores, -(-rows // MOST_ROWS))))


def _stream_form(plan: _Plan, queries: tiles.Tiles, chunks: tiles.Tiles, shares: int) -> DataFrame:
    """Every task holds one tile and lets all chunks pass it, or a share where there are few tiles."""
    files, columns = queries.files, queries.table.columns
    passed, names, rows = chunks.files, chunks.table.columns, chunks.rows
    units = len(files) * shares

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch["id"].to_pylist():
                tile, share = divmod(unit, shares)
                asked = plan.groups(tiles.load(files[tile], columns))
                # One task meets every row of an id that repeats: they must not fill its ranks.
                tasks = {key: _Task(plan, key, some, distinct=True) for key, some in asked.items()}
                sets = {key[0] for key in tasks}
                for file in passed[share::shares]:
                    for piece in tiles.batches(file, names, rows, PIECE_BYTES, sets):
                        for key, some in plan.groups(piece).items():
                            if key in tasks:
                                tasks[key].feed(some)
                for task in tasks.values():
                    yield from task.results()

    return queries.table.sparkSession.range(0, units, 1, max(units, 1)).mapInArrow(score, plan.schema)


def floors(sample: DataFrame, keys: Sequence[str], k: int, parent_k: int) -> DataFrame:
    """(keys, query_id, a floor for each level): the last rank's score, where a query fills its ranks."""
    ranked = rank_targets(sample, keys, k, parent_k)
    last = {CHUNK: k, PARENT: parent_k}
    score = [
        F.max(F.when((F.col("level") == level) & (F.col("rank") == last[level]), F.col("score"))).alias(FLOORS[level])
        for level in (CHUNK, PARENT)
        if last[level]
    ]
    return ranked.groupBy(*keys, "query_id").agg(*score)


def _grid_form(
    plan: _Plan, queries: DataFrame, chunks: DataFrame, query_cell: int, chunk_cell: int
) -> DataFrame:
    keys = plan.keys

    q_cells = F.ceil(F.count("*") / F.lit(query_cell)).cast("int").alias("_q_cells")
    by_rows = F.ceil(F.count("*") / F.lit(chunk_cell))
    by_size = F.ceil(F.sum(plan.scorer.elements()) / F.lit(CELL_ELEMENTS))
    d_cells = F.greatest(by_rows, by_size, F.lit(1)).cast("int").alias("_d_cells")
    counts = queries.groupBy(*keys).agg(q_cells).join(chunks.groupBy(*keys).agg(d_cells), keys)
    # One row per data set (and trial): as few as the suite and the sampling plan name.
    counts = one_per_dataset(counts)

    def placed(side: DataFrame, id_name: str, own: str, other: str) -> DataFrame:
        spread = (
            side.join(counts, keys)
            .withColumn(own, F.pmod(F.xxhash64(id_name), F.col(f"{own}s")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            .drop("_q_cells", "_d_cells")
        )
        # Both sides may come from one table; new names keep their columns apart.
        return spread.select(*[F.col(name).alias(name) for name in spread.columns])

    cell = [*keys, "_q_cell", "_d_cell"]
    left = placed(queries, "query_id", "_q_cell", "_d_cell").groupBy(*cell)
    right = placed(chunks, "chunk_id", "_d_cell", "_q_cell").groupBy(*cell)

    def score(key, some_queries: pa.Table, some_chunks: pa.Table) -> pa.Table:
        if not some_queries.num_rows or not some_chunks.num_rows:
            return plan.arrow.empty_table()
        task = _Task(plan, tuple(v.as_py() for v in key[: len(keys)]), some_queries)
        task.feed(some_chunks)
        return pa.Table.from_batches(list(task.results()), schema=plan.arrow)

    return left.cogroup(right).applyInArrow(score, plan.schema)


def best_targets(queries: DataFrame, chunks: DataFrame, scorer, *args, **options) -> DataFrame:
    """Candidates per query as ``candidates`` finds them, without their number."""
    return candidates(queries, chunks, scorer, *args, **options)[0]


def candidates(
    queries: DataFrame,
    chunks: DataFrame,
    scorer,
    keys: Sequence[str] = ("dataset",),
    k: int = 100,
    parent_k: int = 0,
    ignore_identical_ids: bool = True,
    form: str = "auto",
    query_cell: int = QUERY_CELL,
    chunk_cell: int = CHUNK_CELL,
    with_floors: bool | None = None,
    floor_every: int = FLOOR_EVERY,
) -> tuple[DataFrame, int]:
    """Candidates per query, a superset of its top-k in which every top-k score is final, and about how many at most.

    Rows: keys, level ('chunk' or 'parent'), query_id, target_id, score. ``rank_targets``
    brings the tasks' candidates together. ``with_floors`` None: with few queries where the chunks are read
    by many tasks; with many always, as a task that all chunks pass has its floors from those before.
    The number is 0 where it is not known.
    """
    left = queries.select(*keys, "query_id", *scorer.query_columns)
    right = chunks.select(*keys, "chunk_id", *scorer.chunk_columns)
    fields = [right.schema[name] for name in keys]
    plan = _Plan(scorer, keys, fields, k, parent_k, ignore_identical_ids)
    if form == "auto":
        # Rows first, then numbers or tokens: nothing is collected before both are known to fit.
        some = left.limit(BROADCAST_QUERIES + 1)
        size = some.agg(F.count("*").alias("rows"), F.sum(scorer.query_elements()).alias("elements")).first()
        fit = size["rows"] <= BROADCAST_QUERIES and (size["elements"] or 0) <= BROADCAST_ELEMENTS
        form = "broadcast" if fit else "tiles"
    if form == "grid":
        return _grid_form(plan, left, right, query_cell, chunk_cell), 0
    if form not in ("broadcast", "tiles"):
        raise ValueError(f"unknown form: {form}")
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    if form == "broadcast":
        scans = scan_tasks(right)
        if with_floors is None:
            with_floors = scans >= FLOOR_TASKS
        few = left.toArrow()
        each = few.num_rows * (k + parent_k)
        if not with_floors:
            return _broadcast_form(plan, few, right), each * max(scans, cores)
        found = floors(_broadcast_form(plan, few, right, floor_every), keys, k, parent_k)
        # As many rows as the queries, which fit.
        joined = left.join(F.broadcast(found), [*keys, "query_id"], "left").select(*left.columns, *floor_columns(k, parent_k))
        return _broadcast_form(plan, joined.toArrow(), right), each * FLOOR_EVERY
    if with_floors is False:
        stored = tiles.written(left, keys, scorer.query_elements(), query_cell, CELL_ELEMENTS)
        if not stored.readable():
            return _grid_form(plan, stored.table, right, query_cell, chunk_cell), 0
        return _tile_form(plan, stored, right, chunk_cell), 0
    wanted = TASKS_A_CORE * cores
    fewest, most = STREAM_QUERIES
    stored = tiles.written(
        left, keys, scorer.query_elements(), min(query_cell, most), STREAM_BYTES // 8, wanted, min(query_cell, fewest)
    )
    if not stored.readable():
        return _grid_form(plan, stored.table, right, query_cell, chunk_cell), 0
    passed = tiles.kept(scorer.stored(right), scorer.stored_elements(), min(chunk_cell, STREAM_ROWS), PIECE_BYTES // 8)
    shares = stream_shares(len(stored.files), len(passed.files), passed.total, wanted)
    return _stream_form(plan, stored, passed, shares), stored.total * (k + parent_k) * shares


def floor_columns(k: int, parent_k: int) -> list[str]:
    return [FLOORS[level] for level, depth in ((CHUNK, k), (PARENT, parent_k)) if depth]


def rank_targets(
    candidates: DataFrame,
    keys: Sequence[str] = ("dataset",),
    k: int = 100,
    parent_k: int = 0,
    levels: int = 1,
    rows: int = 0,
) -> DataFrame:
    """Final order: score descending, ties by id descending.

    Every scoring task reports up to k rows a query. With floors that is few rows in all; without, two
    ``levels`` merge groups of tasks first, so that what meets in the end is k rows a query and group.
    All cuts are exact. Rows of one target are merged at either level: several tasks may report the
    same parent. With many candidates (``rows``, about) the tasks grow in number and not in size: by their
    bytes, which compress well, Spark would put millions of them into one.
    """
    query = [*keys, "level", "query_id"]
    parts = -(-rows // RANK_ROWS)
    dealt = [parts] if parts > candidates.sparkSession.sparkContext.defaultParallelism else []
    depth = F.when(F.col("level") == PARENT, F.lit(parent_k)).otherwise(F.lit(k)) if parent_k else F.lit(k)

    def best(rows: DataFrame, within: list[str]) -> DataFrame:
        order = Window.partitionBy(*within).orderBy(F.desc("score"), F.desc("target_id"))
        merged = rows.repartition(*dealt, *within).groupBy(*within, "target_id").agg(F.max("score").alias("score"))
        return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)

    if levels > 1:
        group = F.floor(F.spark_partition_id() / F.lit(MERGE_GROUP)).alias("_group")
        candidates = best(candidates.select("*", group), [*query, "_group"]).drop("_group", "rank")
    return best(candidates, query).select(*query, "target_id", "score", "rank")
