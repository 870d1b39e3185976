"""DuckDB SQL for every registered query, written independently of the Spark code.

Pieces are common table expressions joined with commas. Scores are computed for all pairs here:
the SQL says what the answer is, the Spark jobs find it without the pairs.
"""

from __future__ import annotations

KS = (1, 5, 10, 50, 100)
SIZES = (1, 2, 5, 10, 20, 50, 100, 150, 200)

# --- inputs ----------------------------------------------------------------------------------

CONVERSATIONS = """
corpus AS (
  SELECT 'conversations' AS dataset, conv_id::VARCHAR AS doc_id, turn::INT AS internal_id,
         conv_id || '_' || turn AS chunk_id, text
  FROM conversations),
asked AS (
  SELECT 'conversations' AS dataset, 'q' || conv_id || '_' || turn AS query_id, text,
         conv_id::VARCHAR AS doc_id, (turn + 1)::INT AS internal_id,
         conv_id || '_' || (turn + 1) AS chunk_id
  FROM conversations WHERE role = 'user'),
qrels AS (
  SELECT a.dataset, a.query_id, a.chunk_id AS target_id, 0 AS label_pos
  FROM asked a JOIN corpus c ON c.chunk_id = a.chunk_id)
"""

NUMBERED_QUESTIONS = """
turns AS (SELECT *, row_number() OVER () AS file_row FROM conversations),
questions AS (
  SELECT conv_id, turn, text, row_number() OVER (ORDER BY file_row) - 1 AS query_pos
  FROM turns WHERE role = 'user')
"""

HOLED_RUN = r"""
numbered AS (
  SELECT DISTINCT source AS query_id, regexp_extract(source, '(\d+)', 1)::INT AS number FROM documents),
run AS (
  SELECT query_id, (CASE WHEN doc_id % 89 = number AND number % 3 = 1 THEN doc_id - 1 ELSE doc_id END)::VARCHAR AS target_id
  FROM documents CROSS JOIN numbered WHERE NOT (doc_id % 97 = number AND number % 3 = 0))
"""

LAST_TURNS = """
corpus AS (
  SELECT 'conversations' AS dataset, conv_id::VARCHAR AS doc_id, conv_id || '_0' AS chunk_id,
         arg_max(text, turn) AS text
  FROM conversations GROUP BY conv_id),
asked AS (
  SELECT 'conversations' AS dataset, 'q' || u.conv_id || '_' || u.turn AS query_id, u.text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user'),
qrels AS (
  SELECT 'conversations' AS dataset, 'q' || u.conv_id || '_' || u.turn AS query_id,
         u.conv_id || '_0' AS target_id, 0 AS label_pos
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user')
"""

LINES = r"""
split_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents),
lines AS (
  SELECT 'lines' AS dataset, doc_id::VARCHAR AS doc_id, place::INT AS internal_id,
         doc_id || '_' || place AS chunk_id, line AS text, lower(line) AS og_text
  FROM split_lines WHERE trim(line, ' ') <> '')
"""

PASSAGE_LABELS = r"""
labels_found AS (
  SELECT b.item_id, d.doc_id, b.text AS passage, d.text,
         len(list_filter(regexp_split_to_array(left(d.text, instr(d.text, b.text) - 1), '\s+'),
                         lambda w: w <> '')) AS start_word
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))
"""


def passages(prefix: str = "q") -> str:
    return (
        PASSAGE_LABELS
        + f""",
corpus AS (
  SELECT 'passages' AS dataset, doc_id::VARCHAR AS doc_id, doc_id::VARCHAR AS chunk_id, text
  FROM documents),
asked AS (
  SELECT 'passages' AS dataset, '{prefix}' || item_id AS query_id, item_id AS query_pos, text
  FROM benchmark),
qrels AS (
  SELECT 'passages' AS dataset, '{prefix}' || item_id AS query_id, doc_id::VARCHAR AS target_id,
         doc_id AS label_pos
  FROM labels_found)
"""
    )


VECTORS = """
corpus AS (
  SELECT 'vectors' AS dataset, (vec_id // 5)::VARCHAR AS doc_id, (vec_id % 5)::INT AS internal_id,
         (vec_id // 5) || '_' || (vec_id % 5) AS chunk_id, embedding::DOUBLE[] AS vector
  FROM embeddings),
asked AS (SELECT dataset, chunk_id AS query_id, vector FROM corpus),
qrels AS (
  SELECT a.dataset, a.chunk_id AS query_id, b.chunk_id AS target_id, b.internal_id AS label_pos
  FROM corpus a JOIN corpus b ON a.doc_id = b.doc_id AND a.internal_id <> b.internal_id)
"""

TOKENS = """
query_tokens AS (
  SELECT 'tokens' AS dataset, 'q' || (vec_id // 4) AS query_id, (vec_id % 4)::INT AS tok_pos,
         embedding::DOUBLE[] AS vector
  FROM embeddings),
chunk_tokens AS (
  SELECT 'tokens' AS dataset,
         (vec_id // 10) || '_' || (CASE WHEN vec_id % 10 >= 3 THEN 1 ELSE 0 END) AS chunk_id,
         embedding::DOUBLE[] AS vector
  FROM embeddings),
qrels AS (
  SELECT 'tokens' AS dataset, 'q' || (vec_id // 4) AS query_id,
         (vec_id // 10) || '_' || (CASE WHEN vec_id % 10 >= 3 THEN 1 ELSE 0 END) AS target_id,
         0 AS label_pos
  FROM embeddings WHERE vec_id % 4 = 0)
"""

LENGTHS = (
    PASSAGE_LABELS
    + """,
bucketed AS (
  SELECT doc_id, text,
         CASE WHEN n_chars < 1024 THEN 256 WHEN n_chars < 4096 THEN 1024 ELSE 4096 END AS context_length
  FROM documents),
length_labels AS (
  SELECT l.item_id, l.doc_id, 'q' || l.item_id || '_' || b.context_length AS qid
  FROM labels_found l JOIN bucketed b ON l.doc_id = b.doc_id),
length_queries AS (
  SELECT DISTINCT l.qid, q.text, q.item_id FROM length_labels l JOIN benchmark q ON q.item_id = l.item_id)
"""
)

LENGTH_TASK = (
    LENGTHS
    + """,
wanted AS (SELECT unnest([256, 1024, 4096]) AS bucket),
corpus AS (
  SELECT 'needle_' || context_length AS dataset, doc_id::VARCHAR AS doc_id,
         doc_id::VARCHAR AS chunk_id, text
  FROM bucketed JOIN wanted ON bucket = context_length),
asked AS (
  SELECT 'needle_' || bucket AS dataset, qid AS query_id, text
  FROM length_queries JOIN wanted ON contains(qid, bucket::VARCHAR)),
qrels AS (
  SELECT a.dataset, a.query_id, l.doc_id::VARCHAR AS target_id, l.doc_id AS label_pos
  FROM asked a JOIN length_labels l ON l.qid = a.query_id)
"""
)

SWEEP = (
    PASSAGE_LABELS
    + r""",
sizes AS (SELECT unnest([100, 250, 500, 1000]) AS size),
worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words FROM documents),
cut AS (
  SELECT doc_id, words, size, unnest(range(ceil(len(words) / size)::BIGINT)) AS i
  FROM worded CROSS JOIN sizes WHERE len(words) > 0),
corpus AS (
  SELECT 'words-' || size AS dataset, doc_id::VARCHAR AS doc_id, i::INT AS internal_id,
         doc_id || '_' || i AS chunk_id,
         array_to_string(words[(i * size + 1):(i * size + size)], ' ') AS text
  FROM cut),
qrels AS (
  SELECT 'words-' || size AS dataset, 'q' || item_id AS query_id,
         doc_id || '_' || (start_word // size) AS target_id, doc_id AS label_pos
  FROM labels_found CROSS JOIN sizes),
asked AS (
  SELECT 'words-' || size AS dataset, 'q' || item_id AS query_id, text
  FROM benchmark CROSS JOIN sizes
  WHERE 'q' || item_id IN (SELECT query_id FROM qrels))
"""
)

LABELLED_ONLY = """
asked_labelled AS (
  SELECT * FROM asked WHERE (dataset, query_id) IN (SELECT (dataset, query_id) FROM qrels))
"""

# --- scorers: each ends in scores(dataset, query_id, target_id, score) -----------------------

DENSE = """
scores AS (
  SELECT q.dataset, q.query_id, c.chunk_id AS target_id,
         round(list_dot_product(q.vector, c.vector), 6) AS score
  FROM asked q JOIN corpus c ON q.dataset = c.dataset)
"""


def maxsim(floor: bool = False) -> str:
    best = "max(list_dot_product(q.vector, c.vector))"
    if floor:
        best = f"CASE WHEN any_value(l.padded) THEN greatest({best}, 0.0) ELSE {best} END"
    return f"""
unit_queries AS (
  SELECT dataset, query_id, tok_pos,
         list_transform(vector, lambda x: x / greatest(sqrt(list_dot_product(vector, vector)), 1e-12)) AS vector
  FROM query_tokens),
unit_chunks AS (
  SELECT dataset, chunk_id,
         list_transform(vector, lambda x: x / greatest(sqrt(list_dot_product(vector, vector)), 1e-12)) AS vector
  FROM chunk_tokens),
lengths AS (
  SELECT chunk_id, count(*) < max(count(*)) OVER () AS padded FROM chunk_tokens GROUP BY chunk_id),
best AS (
  SELECT q.dataset, q.query_id, q.tok_pos, c.chunk_id, {best} AS sim
  FROM unit_queries q JOIN unit_chunks c ON q.dataset = c.dataset
  JOIN lengths l ON l.chunk_id = c.chunk_id
  GROUP BY ALL),
scores AS (
  SELECT dataset, query_id, chunk_id AS target_id, round(sum(sim), 6) AS score
  FROM best GROUP BY ALL)
"""


TOKENISE = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"

BM25_TERMS = f"""
chunk_words AS (
  SELECT dataset, chunk_id, {TOKENISE.format('text')} AS words FROM corpus),
chunk_sizes AS (
  SELECT dataset, count(*) AS n, avg(len(words)) AS avgdl FROM chunk_words GROUP BY dataset),
tf AS (
  SELECT dataset, chunk_id, any_value(len(words)) AS dl, term, count(*) AS tf
  FROM (SELECT dataset, chunk_id, words, unnest(words) AS term FROM chunk_words)
  GROUP BY dataset, chunk_id, term),
df AS (SELECT dataset, term, count(*) AS df FROM tf GROUP BY dataset, term),
raw_idf AS (
  SELECT dataset, term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf
  FROM df JOIN chunk_sizes USING (dataset)),
mean_idf AS (SELECT dataset, avg(raw_idf) AS mean_idf FROM raw_idf GROUP BY dataset),
idf AS (
  SELECT dataset, term, df, avgdl,
         CASE WHEN raw_idf < 0 THEN 0.25 * mean_idf ELSE raw_idf END AS idf
  FROM raw_idf JOIN mean_idf USING (dataset))
"""


def bm25(asked: str = "asked") -> str:
    return (
        BM25_TERMS
        + f""",
query_words AS (
  SELECT dataset, query_id, unnest({TOKENISE.format('text')}) AS term FROM {asked}),
query_terms AS (
  SELECT dataset, query_id, term, count(*) AS times FROM query_words GROUP BY ALL),
matched AS (
  SELECT dataset, query_id, chunk_id,
         sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM query_terms JOIN idf USING (dataset, term) JOIN tf USING (dataset, term)
  GROUP BY dataset, query_id, chunk_id),
scores AS (
  SELECT q.dataset, q.query_id, c.chunk_id AS target_id, round(coalesce(m.score, 0), 6) AS score
  FROM {asked} q JOIN corpus c ON q.dataset = c.dataset
  LEFT JOIN matched m ON m.dataset = q.dataset AND m.query_id = q.query_id AND m.chunk_id = c.chunk_id)
"""
    )


# --- ranking and metrics ---------------------------------------------------------------------


def ranked(scores: str = "scores", keys: str = "dataset", name: str = "run", k: int = 100) -> str:
    return f"""
{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, query_id ORDER BY score DESC, target_id DESC) AS rank
  FROM {scores} WHERE query_id <> target_id),
{name} AS (SELECT * FROM {name}_ranked WHERE rank <= {k})
"""


def per_query(
    run: str = "run", qrels: str = "qrels", keys: str = "dataset", name: str = "pq", ks=KS
) -> str:
    same = " AND ".join(f"r.{c.strip()} = l.{c.strip()}" for c in [*keys.split(","), "query_id"])
    same_set = f"USING ({keys}, query_id)"
    columns = []
    for k in ks:
        ideal = f"list_sum(list_transform(range(1, least(relevant, {k}) + 1), lambda i: 1 / log2(i + 1)))"
        columns += [
            f"coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= {k}), 0) / {ideal} AS ndcg_at_{k}",
            f"coalesce(sum(hit_no / rank) FILTER (hit AND rank <= {k}), 0) / relevant AS map_at_{k}",
            f"count(*) FILTER (hit AND rank <= {k}) / relevant AS recall_at_{k}",
            f"count(*) FILTER (hit AND rank <= {k}) / {k} AS precision_at_{k}",
        ]
    return f"""
{name}_labels AS (SELECT DISTINCT {keys}, query_id, target_id FROM {qrels}),
{name}_relevant AS (
  SELECT {keys}, query_id, count(*) AS relevant FROM {name}_labels GROUP BY {keys}, query_id),
{name}_hits AS (
  SELECT r.*, l.target_id IS NOT NULL AS hit FROM {run} r
  LEFT JOIN {name}_labels l ON {same} AND r.target_id = l.target_id),
{name}_counted AS (
  SELECT *, count(*) FILTER (hit) OVER (PARTITION BY {keys}, query_id ORDER BY rank) AS hit_no
  FROM {name}_hits),
{name} AS (
  SELECT {keys}, query_id, {', '.join(columns)}
  FROM {name}_counted JOIN {name}_relevant {same_set}
  GROUP BY {keys}, query_id, relevant)
"""


def macro(pq: str = "pq", keys: str = "dataset", name: str = "means", ks=KS) -> str:
    names = [f"{m}_at_{k}" for m in ("ndcg", "map", "recall", "precision") for k in ks]
    means = ", ".join(f"round_even(avg({n}), 5) AS {n}" for n in names)
    return f"""
{name}_wide AS (SELECT {keys}, {means} FROM {pq} GROUP BY {keys}),
{name} AS (
  SELECT {keys}, metric, value
  FROM (UNPIVOT {name}_wide ON {', '.join(names)} INTO NAME metric VALUE value))
"""


PARENT_MAX = (
    """
parent_scores AS (
  SELECT dataset, query_id, split_part(target_id, '_', 1) AS target_id, max(score) AS score
  FROM scores WHERE query_id <> target_id GROUP BY ALL),
parent_labels AS (
  SELECT DISTINCT dataset, query_id, split_part(target_id, '_', 1) AS target_id FROM qrels),
"""
    + ranked("parent_scores", name="parent_run", k=10)
    + ","
    + per_query("parent_run", "parent_labels", name="parent_pq", ks=(10,))
    + """,
parent_means AS (
  SELECT dataset, 'ndcg_at_10_maxsim' AS metric, round_even(avg(ndcg_at_10), 5) AS value
  FROM parent_pq GROUP BY dataset)
"""
)

POSITIONAL = """
first_label AS (
  SELECT dataset, query_id, split_part(arg_min(target_id, label_pos), '_', -1) AS position
  FROM qrels GROUP BY dataset, query_id),
slices AS (
  SELECT dataset, position, round_even(avg(ndcg_at_10), 5) AS mean, count(*)::DOUBLE AS support
  FROM pq JOIN first_label USING (dataset, query_id) GROUP BY dataset, position),
position_means AS (
  SELECT dataset, 'ndcg_at_10_at_' || position AS metric, mean AS value FROM slices
  UNION ALL
  SELECT dataset, 'support_at_' || position, support FROM slices)
"""

SAMPLES = f"""
all_parents AS (SELECT DISTINCT dataset, split_part(chunk_id, '_', 1) AS parent FROM corpus),
parent_counts AS (SELECT dataset, count(*) AS parents FROM all_parents GROUP BY dataset),
planned AS (
  SELECT dataset, n, unnest(range(floor(500 / sqrt(n))::BIGINT)) AS trial
  FROM parent_counts CROSS JOIN (SELECT unnest({list(SIZES)}) AS n) WHERE n <= parents),
drawn AS (
  SELECT dataset, n, trial, parent,
         row_number() OVER (PARTITION BY dataset, n, trial
                            ORDER BY md5('42:' || n || ':' || trial || ':' || parent), parent) AS place
  FROM planned JOIN all_parents USING (dataset)),
samples AS (SELECT dataset, n, trial, parent FROM drawn WHERE place <= n)
"""

SCALING = (
    """
trial_labels AS (
  SELECT s.dataset, s.n, s.trial, l.query_id, l.target_id
  FROM qrels l JOIN samples s ON s.dataset = l.dataset AND s.parent = split_part(l.target_id, '_', 1)),
trial_queries AS (SELECT DISTINCT dataset, n, trial, query_id FROM trial_labels),
parented AS (SELECT *, split_part(target_id, '_', 1) AS parent FROM scores),
trial_scores AS (
  SELECT q.dataset, q.n, q.trial, q.query_id, c.target_id, c.score
  FROM trial_queries q
  JOIN samples s ON s.dataset = q.dataset AND s.n = q.n AND s.trial = q.trial
  JOIN parented c ON c.dataset = q.dataset AND c.query_id = q.query_id AND c.parent = s.parent),
"""
    + ranked("trial_scores", "dataset, n, trial", "trial_run", 10)
    + ","
    + per_query("trial_run", "trial_labels", "dataset, n, trial", "trial_pq", (10,))
    + """,
trial_means AS (
  SELECT dataset, n, trial, round_even(avg(ndcg_at_10), 5) AS value FROM trial_pq GROUP BY ALL),
size_means AS (
  SELECT p.dataset, p.n, avg(m.value) AS mean, count(*) FILTER (m.value IS NULL)::DOUBLE AS empty_trials
  FROM planned p LEFT JOIN trial_means m USING (dataset, n, trial) GROUP BY ALL),
scaling_means AS (
  SELECT dataset, 'ndcg_at_10_sample_' || n AS metric, round(mean, 6) AS value FROM size_means
  UNION ALL
  SELECT dataset, 'empty_trials_' || n, empty_trials FROM size_means)
"""
)


def query(*parts: str) -> str:
    """WITH all but the last part, then the last as the final SELECT."""
    return "WITH " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]


RUN_ROWS = "SELECT dataset, query_id, target_id, score, rank FROM run"
MEAN_ROWS = "SELECT dataset, metric, value FROM means"
WITH_PARENTS = MEAN_ROWS + " UNION ALL SELECT dataset, metric, value FROM parent_means"

ENCODED = r"""
words AS (SELECT *, {words} AS words FROM corpus),
exploded AS (SELECT chunk_id, unnest(words) AS term FROM words),
hashed AS (
  SELECT chunk_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS dim,
         CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END AS sign
  FROM exploded),
sums AS (SELECT chunk_id, dim, sum(sign)::DOUBLE AS total FROM hashed GROUP BY ALL),
norms AS (SELECT chunk_id, sqrt(sum(total * total)) AS norm FROM sums GROUP BY ALL),
encoded AS (
  SELECT c.chunk_id, d.dim, coalesce(s.total, 0) / greatest(coalesce(n.norm, 0), 1e-12) AS value
  FROM corpus c CROSS JOIN (SELECT unnest(range(64)) AS dim) d
  LEFT JOIN sums s ON s.chunk_id = c.chunk_id AND s.dim = d.dim
  LEFT JOIN norms n ON n.chunk_id = c.chunk_id)
"""


def encoded() -> str:
    return ENCODED.replace("{words}", TOKENISE.format("text"))


def oracle_sql() -> dict[str, str]:
    dense_run = (VECTORS, DENSE, ranked())
    sql: dict[str, str] = {}

    # ids and views
    sql["parse_chunk_id"] = query(
        CONVERSATIONS, "SELECT chunk_id, doc_id, internal_id FROM corpus"
    )
    sql["parse_chunk_ids"] = query(
        LINES,
        """SELECT doc_id, array_to_string(list(chunk_id ORDER BY internal_id), ' ') AS chunk_ids,
                  array_to_string(list(internal_id ORDER BY internal_id), ' ') AS internal_ids
           FROM lines GROUP BY doc_id""",
    )
    sql["parent_and_position"] = query(
        CONVERSATIONS,
        """SELECT chunk_id, split_part(chunk_id, '_', 1) AS parent, split_part(chunk_id, '_', -1) AS position
           FROM corpus""",
    )
    sql["distinct_parents"] = query(
        CONVERSATIONS,
        """SELECT 'parent' AS kind, split_part(chunk_id, '_', 1) AS value FROM corpus GROUP BY ALL
           UNION ALL
           SELECT 'position', split_part(target_id, '_', -1) FROM qrels GROUP BY ALL""",
    )
    sql["chunk_swap"] = query(
        LINES,
        """SELECT chunk_id,
                  CASE WHEN ('0x' || substr(md5('42:' || chunk_id), 1, 8))::BIGINT / 4294967296.0 < 0.3
                       THEN og_text ELSE text END AS text
           FROM lines""",
    )
    sql["prompted_flat_docs"] = query(
        LINES, "SELECT chunk_id, 'search_document: ' || text AS text FROM lines"
    )
    sql["prompted_queries"] = query(
        CONVERSATIONS, "SELECT query_id, 'search_query: ' || text AS text FROM asked"
    )
    sql["nested_docs"] = query(
        CONVERSATIONS,
        """SELECT doc_id, array_to_string(list(chunk_id ORDER BY internal_id), ' ') AS chunk_ids,
                  array_to_string(list(text ORDER BY internal_id), ' | ') AS texts
           FROM corpus GROUP BY doc_id""",
    )
    sql["nested_queries"] = query(
        CONVERSATIONS,
        """SELECT doc_id, array_to_string(list(chunk_id ORDER BY internal_id), ' ') AS chunk_ids,
                  array_to_string(list(text ORDER BY internal_id), ' | ') AS texts
           FROM asked GROUP BY doc_id""",
    )
    sql["flatten_nested"] = query(
        CONVERSATIONS,
        """SELECT doc_id, chunk_id, text,
                  row_number() OVER (PARTITION BY doc_id ORDER BY internal_id) - 1 AS place
           FROM corpus""",
    )
    sql["singleton_nested"] = """
        SELECT doc_id::VARCHAR AS doc_id, doc_id::VARCHAR AS chunk_ids, text AS texts FROM documents"""
    sql["collect_labels"] = query(
        passages(),
        """SELECT query_id, array_to_string(list(target_id ORDER BY label_pos), ' ') AS target_ids
           FROM qrels GROUP BY query_id""",
    )
    sql["context_filter_docs"] = query(
        LENGTHS,
        "SELECT doc_id::VARCHAR AS doc_id, text FROM bucketed WHERE context_length = 256",
    )
    sql["context_filter_queries"] = query(
        LENGTHS, "SELECT qid, text FROM length_queries WHERE contains(qid, '256')"
    )

    sql["chunked_source"] = query(
        NUMBERED_QUESTIONS,
        """SELECT query_pos::VARCHAR AS query_id, query_pos, text, conv_id::VARCHAR AS doc_id,
                  conv_id || '_' || (turn + 1) AS target_id, 0 AS label_pos FROM questions""",
    )
    sql["triple_source"] = query(
        PASSAGE_LABELS,
        """placed AS (SELECT item_id, row_number() OVER (ORDER BY file_row) - 1 AS query_pos
                      FROM (SELECT item_id, row_number() OVER () AS file_row FROM benchmark))""",
        """SELECT item_id::VARCHAR AS query_id, query_pos, doc_id::VARCHAR AS target_id,
                  row_number() OVER (ORDER BY item_id, doc_id) - 1 AS label_pos
           FROM labels_found JOIN placed USING (item_id)""",
    )
    sql["length_positions"] = query(
        LENGTHS,
        """numbered AS (
             SELECT qid, bucket, item_id, split_part(qid, '_', 2)::INT AS own
             FROM length_queries JOIN (SELECT unnest([256, 1024, 4096]) AS bucket) ON contains(qid, bucket::VARCHAR))""",
        """SELECT 'needle_' || bucket AS dataset, qid AS query_id,
                  row_number() OVER (PARTITION BY bucket ORDER BY item_id, own) - 1 AS query_pos FROM numbered""",
    )
    sql["swap_then_prompt"] = query(
        CONVERSATIONS,
        """SELECT chunk_id, 'search_document: ' ||
                  CASE WHEN ('0x' || substr(md5('42:' || chunk_id), 1, 8))::BIGINT / 4294967296.0 < 0.3
                       THEN lower(text) ELSE text END AS text
           FROM corpus""",
    )
    sql["nested_without_prompt"] = sql["nested_docs"]
    sql["prompted_set_stats"] = query(
        CONVERSATIONS,
        CORPUS_STATS.replace("{corpus}", "corpus"),
        QUERY_STATS.replace("'text'", "text").replace("FROM asked", "FROM (SELECT 'search_query: ' || text AS text FROM asked)"),
        f"SELECT * FROM ({QUERY_STATS_ROWS}) CROSS JOIN ({CORPUS_STATS_ROWS})",
    )

    # joins and checks
    sql["query_label_join"] = query(
        passages(),
        "SELECT query_id, text, target_id FROM asked JOIN qrels USING (dataset, query_id)",
    )
    sql["label_violations"] = """
        SELECT source AS query_id, doc_id::VARCHAR AS target_id FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
    sql["unlabelled_queries"] = query(
        passages(),
        "SELECT query_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM qrels)",
    )
    sql["evaluated_queries"] = query(
        passages(), bm25(), ranked(), "SELECT DISTINCT query_id FROM run JOIN qrels USING (dataset, query_id)"
    )
    sql["run_shape_check"] = query(
        *dense_run,
        """SELECT query_id, count(*) AS scored, (SELECT count(*) FROM corpus) AS chunks,
                  count(*) = (SELECT count(*) FROM corpus) AS complete
           FROM run GROUP BY query_id""",
    )
    sql["run_coverage"] = query(
        HOLED_RUN,
        """SELECT query_id, count(run.target_id) AS scored, (SELECT count(*) FROM documents) AS chunks,
                  count(run.target_id) = (SELECT count(*) FROM documents)
                  AND count(DISTINCT run.target_id) FILTER (d.doc_id IS NOT NULL) = (SELECT count(*) FROM documents) AS complete
           FROM run LEFT JOIN documents d ON d.doc_id::VARCHAR = run.target_id GROUP BY query_id""",
    )
    sql["coverage_faults"] = query(
        HOLED_RUN,
        "pairs AS (SELECT query_id, target_id, count(*) AS times FROM run GROUP BY ALL)",
        """wanted AS (SELECT DISTINCT source AS query_id, doc_id::VARCHAR AS target_id
                      FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT DISTINCT doc_id FROM documents))""",
        """SELECT query_id, target_id,
                  CASE WHEN p.times IS NULL THEN 'missing' WHEN w.target_id IS NULL THEN 'unknown' ELSE 'repeated' END AS fault,
                  coalesce(p.times, 0) AS times
           FROM wanted w FULL JOIN pairs p USING (query_id, target_id)
           WHERE p.times IS NULL OR w.target_id IS NULL OR p.times > 1""".replace(
            "w.target_id IS NULL", "NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id::VARCHAR = p.target_id)"
        ),
    )
    sql["duplicate_ids"] = """
        SELECT conv_id::VARCHAR AS chunk_id, count(*) AS copies FROM conversations
        GROUP BY conv_id HAVING count(*) > 1"""
    sql["keep_last_duplicate"] = """
        SELECT conv_id::VARCHAR AS chunk_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id"""
    sql["registry_skip"] = """
        SELECT source AS dataset,
               CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'run' ELSE 'skipped' END AS status,
               CASE source WHEN 'src1' THEN 'first' WHEN 'src0' THEN 'src0' WHEN 'src2' THEN 'src2'
                           WHEN 'src3' THEN 'src3' END AS path,
               CASE WHEN source IN ('src0', 'src1', 'src3') THEN 'train' WHEN source = 'src2' THEN 'test' END AS split
        FROM documents GROUP BY source"""

    # vectors
    sql["vector_dims"] = "SELECT len(embedding) AS dim, count(*) AS vectors FROM embeddings GROUP BY ALL"
    sql["l2_normalise"] = """
        WITH long AS (
          SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS dim,
                 sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
          FROM embeddings)
        SELECT vec_id, dim, round(x / greatest(norm, 1e-12), 6) AS value FROM long"""
    sql["mean_over_docs_vectors"] = query(
        VECTORS,
        """long AS (SELECT doc_id, unnest(vector) AS x, unnest(range(len(vector))) AS dim FROM corpus)""",
        "SELECT doc_id AS parent, dim, round(avg(x), 6) AS value FROM long GROUP BY doc_id, dim",
    )

    # dense
    sql["dense_scores_topk"] = query(*dense_run, RUN_ROWS)
    sql["dense_tiles_topk"] = sql["dense_scores_topk"]
    sql["dense_ndcg_at_10"] = query(
        *dense_run, per_query(), macro(), MEAN_ROWS + " WHERE metric = 'ndcg_at_10'"
    )
    sql["dense_metrics"] = query(*dense_run, per_query(), macro(), PARENT_MAX, WITH_PARENTS)
    columns = ", ".join(
        f"round({m}_at_{k}, 6) AS {m}_at_{k}" for m in ("ndcg", "map", "recall", "precision") for k in KS
    )
    sql["dense_per_query"] = query(*dense_run, per_query(), f"SELECT query_id, {columns} FROM pq")
    mean_docs = """
mean_long AS (SELECT doc_id, unnest(vector) AS x, unnest(range(len(vector))) AS dim FROM corpus),
mean_dims AS (SELECT doc_id, dim, avg(x) AS x FROM mean_long GROUP BY ALL),
means_of AS (SELECT doc_id, list(x ORDER BY dim) AS vector FROM mean_dims GROUP BY doc_id),
parent_qrels AS (
  SELECT DISTINCT dataset, query_id, split_part(target_id, '_', 1) AS target_id FROM qrels),
scores AS (
  SELECT 'vectors' AS dataset, q.query_id, m.doc_id AS target_id,
         round(list_dot_product(q.vector, m.vector), 6) AS score
  FROM asked q CROSS JOIN means_of m)
"""
    sql["mean_over_docs_metrics"] = query(
        VECTORS, mean_docs, ranked(), per_query(qrels="parent_qrels"), macro(), PARENT_MAX, WITH_PARENTS
    )
    sql["identical_id_filter"] = query(
        passages(""), bm25(), ranked(), RUN_ROWS
    )
    numbered = """
shifted AS (SELECT dataset, (query_pos)::VARCHAR AS query_id, text FROM asked)"""
    sql["identical_id_compat"] = query(
        passages(), numbered, bm25("shifted"), ranked(), RUN_ROWS
    )

    # late interaction
    sql["maxsim_scores"] = query(TOKENS, maxsim(), ranked(), RUN_ROWS)
    sql["maxsim_pad_floor"] = query(TOKENS, maxsim(True), ranked(), RUN_ROWS)
    sql["maxsim_metrics"] = query(
        TOKENS, maxsim(), ranked(), per_query(), macro(), PARENT_MAX, WITH_PARENTS
    )

    # lexical
    sql["bm25_idf"] = query(
        passages(), BM25_TERMS, "SELECT term, df, round(idf, 6) AS idf FROM idf"
    )
    sql["bm25_scores_topk"] = query(CONVERSATIONS, bm25(), ranked(), RUN_ROWS)
    sql["bm25_tiles_topk"] = sql["bm25_scores_topk"]
    sizes = """
scores AS (
  SELECT 'triples' AS dataset, q.query_id, d.chunk_id AS target_id,
         round(q.chars + q.words * d.tokens, 6)::DOUBLE AS score
  FROM asked_sizes q CROSS JOIN corpus_sizes d)
"""
    sql["contextual_triples_metrics"] = query(
        PASSAGE_LABELS,
        """
qrels AS (
  SELECT 'triples' AS dataset, item_id::VARCHAR AS query_id, doc_id::VARCHAR AS target_id, doc_id AS label_pos
  FROM labels_found),
asked_sizes AS (
  SELECT item_id::VARCHAR AS query_id, length(text) AS chars, len(string_split(text, ' ')) AS words
  FROM benchmark WHERE item_id IN (SELECT item_id FROM labels_found)),
corpus_sizes AS (
  SELECT doc_id::VARCHAR AS chunk_id, len("""
        + TOKENISE.format("coalesce(text, '')")
        + """) AS tokens FROM documents)""",
        sizes,
        ranked(),
        per_query(),
        macro(),
        PARENT_MAX,
        WITH_PARENTS,
    )
    sql["bm25_metrics"] = query(
        passages(), LABELLED_ONLY, bm25("asked_labelled"), ranked(), per_query(), macro(), PARENT_MAX, WITH_PARENTS
    )

    sql["duplicate_ids_metrics"] = query(
        LAST_TURNS, bm25(), ranked(), per_query(), macro(), PARENT_MAX, WITH_PARENTS
    )

    # analyses
    sql["parent_max_metrics"] = query(
        CONVERSATIONS, bm25(), PARENT_MAX, "SELECT dataset, metric, value FROM parent_means"
    )
    sql["positional_metrics"] = query(
        CONVERSATIONS,
        bm25(),
        ranked(),
        per_query(),
        POSITIONAL,
        "SELECT dataset, metric, value FROM position_means",
    )
    sql["scaling_samples"] = query(
        CONVERSATIONS, SAMPLES, "SELECT n, trial, parent FROM samples"
    )
    sql["scaling_metrics"] = query(
        CONVERSATIONS, bm25(), SAMPLES, SCALING, "SELECT dataset, metric, value FROM scaling_means"
    )
    sql["scaling_by_trial"] = sql["scaling_metrics"]
    sql["corpus_stats"] = query(LINES, CORPUS_STATS.replace("{corpus}", "lines"), CORPUS_STATS_ROWS)
    sql["query_stats"] = query(CONVERSATIONS, QUERY_STATS, QUERY_STATS_ROWS)
    sql["dataset_stats"] = query(
        CONVERSATIONS,
        CORPUS_STATS.replace("{corpus}", "corpus"),
        QUERY_STATS,
        f"SELECT * FROM ({QUERY_STATS_ROWS}) CROSS JOIN ({CORPUS_STATS_ROWS})",
    )

    # suites
    sql["multi_context_avg"] = query(
        LENGTH_TASK,
        bm25(),
        ranked(),
        per_query(),
        macro(),
        PARENT_MAX,
        f"""each AS ({WITH_PARENTS})""",
        """SELECT dataset, metric, value FROM each
           UNION ALL
           SELECT 'needle_avg', metric, round(avg(value), 6) FROM each GROUP BY metric""",
    )
    sql["suite_metrics"] = query(
        suite_inputs(),
        bm25(),
        ranked(),
        per_query(),
        macro(),
        PARENT_MAX,
        WITH_PARENTS,
    )
    sql["chunk_size_sweep"] = query(
        SWEEP, bm25(), ranked(), per_query(), macro(), PARENT_MAX, WITH_PARENTS
    )

    # sinks
    sql["metrics_sink_roundtrip"] = sql["dense_metrics"]
    sql["run_metadata"] = query(
        *dense_run,
        per_query(),
        macro(),
        """SELECT dataset, metric, value, 'builtin/dot' AS model_path, 'dot' AS model_name,
                  'dense' AS model_type, '2000-01-01 00:00:00' AS date, false AS extended_context,
                  false AS use_prefix, false AS colbert_model, 0.0::DOUBLE AS runtime
           FROM means WHERE metric = 'ndcg_at_10'""",
    )

    # encoders
    rows = "SELECT chunk_id, dim, round(value, 6) AS value FROM encoded"
    sql["hash_encode"] = query(CONVERSATIONS, encoded(), rows)
    sql["plugin_encode"] = query(
        CONVERSATIONS,
        """SELECT chunk_id, length(text) + 17 AS chars, len(string_split(text, ' ')) + 1 AS words
           FROM corpus""",
    )
    contextual = """
doc_means AS (
  SELECT c.doc_id, e.dim, avg(e.value) AS mean
  FROM encoded e JOIN corpus c USING (chunk_id) GROUP BY ALL),
blended AS (
  SELECT chunk_id, dim, value + 0.5 * mean AS value
  FROM encoded e JOIN corpus c USING (chunk_id) JOIN doc_means m USING (doc_id, dim)),
lengths_of AS (SELECT chunk_id, sqrt(sum(value * value)) AS norm FROM blended GROUP BY ALL)"""
    sql["contextual_encode"] = query(
        CONVERSATIONS,
        encoded(),
        contextual,
        """SELECT chunk_id, dim, round(value / greatest(norm, 1e-12), 6) AS value
           FROM blended JOIN lengths_of USING (chunk_id)""",
    )
    sql["pool_tokens"] = query(
        TOKENS,
        "long AS (SELECT chunk_id, unnest(vector) AS x, unnest(range(len(vector))) AS dim FROM chunk_tokens)",
        "SELECT chunk_id, dim, round(avg(x), 6) AS value FROM long GROUP BY chunk_id, dim",
    )
    sql["late_chunk_vectors"] = """
        WITH tokens AS (
          SELECT vec_id // 20 AS doc, vec_id % 20 AS place, embedding::DOUBLE[] AS vector FROM embeddings),
        spans AS (SELECT DISTINCT doc, unnest([0, 5, 10, 15]) AS low FROM tokens),
        long AS (
          SELECT s.doc || '_' || (low // 5) AS chunk_id, unnest(vector) AS x, unnest(range(len(vector))) AS dim
          FROM spans s JOIN tokens t ON t.doc = s.doc AND place >= low AND place < low + 7)
        SELECT chunk_id, dim, round(avg(x), 6) AS value FROM long GROUP BY chunk_id, dim"""
    sql["plugin_limits"] = query(
        CONVERSATIONS,
        r"""cut AS (
          SELECT chunk_id, text, length(array_to_string(string_split(text, ' ')[1:5], ' ')) AS told,
                 length(regexp_extract(text, '^(?:[^\p{L}\p{N}]*[\p{L}\p{N}]+){1,5}')) AS front
          FROM corpus)""",
        r"""SELECT chunk_id, told,
                  CASE WHEN len(regexp_extract_all(text, '[\p{L}\p{N}]+')) >= 5 THEN front ELSE length(text) END AS cut,
                  length(text) AS lifted
           FROM cut""",
    )
    sql["plugin_contextual"] = query(
        CONVERSATIONS,
        f"""sized AS (
          SELECT doc_id, chunk_id, internal_id, len({TOKENISE.format('text')}) AS n FROM corpus)""",
        """SELECT chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY internal_id) AS place,
                  sum(n) OVER (PARTITION BY doc_id)::BIGINT AS document_tokens
           FROM sized""",
    )
    return sql


CORPUS_STATS = f"""
counted AS (
  SELECT doc_id, len({TOKENISE.format('text')}) AS n FROM {{corpus}}),
per_doc AS (
  SELECT doc_id, sum(n) AS tokens, avg(n) AS per_chunk, count(*) AS chunks FROM counted GROUP BY doc_id)
"""
CORPUS_STATS_ROWS = """
SELECT count(*) AS num_docs, round(avg(tokens), 6) AS average_num_tokens_per_doc,
       round(avg(per_chunk), 6) AS average_num_tokens_per_chunk,
       round(avg(chunks), 6) AS average_num_chunks_per_doc
FROM per_doc"""
QUERY_STATS = f"asked_counts AS (SELECT len({TOKENISE.format('text')}) AS n FROM asked)"
QUERY_STATS_ROWS = """
SELECT count(*) AS num_queries, round(avg(n), 6) AS average_num_tokens_per_query FROM asked_counts"""


def suite_inputs() -> str:
    """Conversations and passages side by side, told apart by dataset."""

    def renamed(ctes: str, suffix: str) -> str:
        for name in ("corpus", "asked", "qrels"):
            ctes = ctes.replace(f"{name} AS", f"{name}_{suffix} AS")
            for use in (f"FROM {name})", f"FROM {name} a ", f"JOIN {name} c "):
                ctes = ctes.replace(use, use.replace(name, f"{name}_{suffix}"))
        return ctes.strip()

    return ",\n".join(
        [
            renamed(CONVERSATIONS, "c"),
            renamed(passages(), "p"),
            """
corpus AS (
  SELECT dataset, doc_id, chunk_id, text FROM corpus_c
  UNION ALL SELECT dataset, doc_id, chunk_id, text FROM corpus_p),
qrels AS (
  SELECT dataset, query_id, target_id, label_pos FROM qrels_c
  UNION ALL SELECT dataset, query_id, target_id, label_pos FROM qrels_p),
asked AS (
  SELECT dataset, query_id, text FROM asked_c
  UNION ALL
  SELECT dataset, query_id, text FROM asked_p
  WHERE query_id IN (SELECT query_id FROM qrels_p))""",
        ]
    )
