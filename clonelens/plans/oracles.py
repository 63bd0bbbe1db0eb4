"""The registered queries as SQL over the given tables, written independently of the Spark plans.

Metrics of the rendered code files come from a closed form instead of a parse;
hash draws use the same md5 rule.  ``=> name`` parts are common table expressions.
"""

from __future__ import annotations

from clonelens.operators.metrics import FRACTIONS, METRICS
from clonelens.operators.pair_features import FEATURES
from clonelens.operators.tokens import END_ID, MAX_LENGTH, PAD_ID, START_ID, VOCABULARY
from clonelens.sources.rendered import CODE_FILES_SQL, NEARLY_EQUAL_SQL, RESULTS_SQL

SIZE = 64  # embedding length


def h(seed: str, value: str) -> str:
    """The seeded hash: the first 32 bits of md5('seed:value')."""
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({value} AS VARCHAR)), 1, 8) AS BIGINT)"


def r6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


CODE = f"code_files AS ({CODE_FILES_SQL.format(part='part')})"
RESULTS = f"results AS ({RESULTS_SQL.format(part='part')})"
SCORED = """scored AS (
  SELECT l.doc_id AS row_id, CAST(l.quality AS BIGINT) AS label, CAST(d.n_chars AS DOUBLE) AS score,
         CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS prediction
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
VECTORS = """vectors AS (
  SELECT vec_id AS row_id, CAST(label >= 5 AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""
EXACT_CUTS = f"""WITH {VECTORS}, cells AS (
  SELECT label, unnest(x) AS v, unnest(range({SIZE})) AS feature FROM vectors
), merged AS (
  SELECT feature, v, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM cells GROUP BY feature, v
), running AS (
  SELECT feature, v, lead(v) OVER o AS up, CAST(sum(n0) OVER o AS DOUBLE) AS l0, CAST(sum(n1) OVER o AS DOUBLE) AS l1,
    CAST(sum(n0) OVER (PARTITION BY feature) AS DOUBLE) AS a0, CAST(sum(n1) OVER (PARTITION BY feature) AS DOUBLE) AS a1
  FROM merged WINDOW o AS (PARTITION BY feature ORDER BY v)
), scored AS (
  SELECT feature, v + (up - v) / 2 AS cut, l0, l1,
    2 * a0 * a1 / (a0 + a1) - 2 * l0 * l1 / (l0 + l1) - 2 * (a0 - l0) * (a1 - l1) / (a0 + a1 - l0 - l1) AS gain
  FROM running WHERE up IS NOT NULL
)
SELECT feature, round(gain, 6) AS gain, round(cut, 6) AS cut, l0, l1 FROM scored
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, cut) = 1"""
BLANK = r"[\t\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _lines(key: str, text: str, table: str) -> str:
    return f"""SELECT {key},
      CAST(length({text}) - length(replace({text}, chr(10), '')) + 1 AS BIGINT) AS num_lines,
      {r6(f"CAST(length(replace({text}, chr(10), '')) AS DOUBLE) / (length({text}) - length(replace({text}, chr(10), '')) + 1)")} AS avg_line_length,
      CAST(len(regexp_extract_all({text}, '(?m)^{BLANK}*#')) AS BIGINT) AS num_comments
    FROM {table}"""


# ---- closed-form metrics of the rendered files ------------------------------------------------

METRIC_CTES = f"""{CODE},
k AS (
  SELECT p_partkey AS file_id, p_partkey % 4 AS c, 1 + p_size % 7 AS a, p_partkey % 3 AS l, p_partkey % 5 AS i,
         CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS m, CASE WHEN p_partkey % 97 <> 0 THEN 1 ELSE 0 END AS ok
  FROM part),
m1 AS (
  SELECT k.file_id, c + 4 + m + a + 2*l + 2*i + (1 - ok) AS num_lines,
    ok AS num_functions, ok*m AS num_classes, ok AS num_imports, ok*(a + 2*l + i) AS num_variables,
    ok*l AS num_loops, ok*i AS num_conditionals, ok*(1 + m) AS max_nesting_depth,
    length(f.content) AS chars, c AS num_comments, 1 + ok*(l + i) AS cyclomatic_complexity,
    ok*(a + l) AS num_operators, ok*(3*a + 5*l + 3*i + 1) AS num_operands,
    ok*(3 + CASE WHEN l > 0 THEN 1 ELSE 0 END + CASE WHEN i > 0 THEN 1 ELSE 0 END) AS vocabulary_size, ok
  FROM k JOIN code_files f ON k.file_id = f.file_id),
m2 AS (
  SELECT *, CAST(chars - (num_lines - 1) AS DOUBLE) / CAST(num_lines AS DOUBLE) AS avg_line_length,
    num_operators + num_operands AS program_length,
    CASE WHEN ok = 1 THEN CAST(num_operators + num_operands AS DOUBLE) * log2(CAST(vocabulary_size + 1 AS DOUBLE))
         ELSE CAST(0 AS DOUBLE) END AS halstead_volume
  FROM m1),
metrics AS (
  SELECT *, CASE WHEN ok = 1 THEN greatest(CAST(0 AS DOUBLE),
      (CAST(171 AS DOUBLE) - CAST(5.2 AS DOUBLE) * ln(halstead_volume)
       - CAST(0.23 AS DOUBLE) * CAST(cyclomatic_complexity AS DOUBLE)
       - CAST(16.2 AS DOUBLE) * ln(CAST(num_lines AS DOUBLE))) * CAST(100 AS DOUBLE) / CAST(171 AS DOUBLE))
    ELSE CAST(0 AS DOUBLE) END AS maintainability_index
  FROM m2)"""


def _metric_columns() -> str:
    return ", ".join(
        f"{r6(m)} AS {m}" if m in FRACTIONS else f"CAST({m} AS BIGINT) AS {m}" for m in METRICS
    )


# nodes per file of each type, in the terms of the closed form
NODE_COUNTS = [
    ("Module", "1"), ("Import", "1"), ("alias", "1"), ("ClassDef", "m"), ("FunctionDef", "1"), ("arguments", "1"),
    ("arg", "2"), ("Assign", "a + l + i"), ("For", "l"), ("If", "i"), ("Return", "1"), ("BinOp", "a + l"),
    ("Name", "3*a + 5*l + 3*i + 1"), ("Store", "a + 2*l + i"), ("Load", "2*a + 3*l + 2*i + 1"), ("Add", "a"), ("Mult", "l"),
]


# ---- pairs ------------------------------------------------------------------------------------

N_FILES = "(SELECT count(*) FROM code_files)"
POSITIVES = f"""ordered_files AS (
  SELECT file_id, row_number() OVER (ORDER BY path, file_id) - 1 AS pair_id FROM code_files),
positives AS (
  SELECT CAST(pair_id AS BIGINT) AS pair_id, file_id AS left_id, file_id AS right_id, 'exact' AS kind, CAST(1 AS BIGINT) AS label
  FROM ordered_files WHERE pair_id < {N_FILES} // 2)"""
REPOS = """repo_sizes AS (
  SELECT repo, count(*) AS n_files FROM code_files GROUP BY repo),
repo_nos AS (
  SELECT repo, n_files, row_number() OVER (ORDER BY repo) - 1 AS repo_no FROM repo_sizes WHERE n_files > 1),
slots AS (
  SELECT f.file_id, f.repo, f.content, row_number() OVER (PARTITION BY f.repo ORDER BY f.file_id) - 1 AS idx
  FROM code_files f JOIN repo_nos r ON f.repo = r.repo),
drawable AS (
  SELECT repo, n_files, row_number() OVER (ORDER BY repo) - 1 AS repo_no
  FROM (SELECT repo, count(*) AS n_files FROM code_files GROUP BY repo HAVING count(DISTINCT content) > 1))"""


def _draws(wanted: str, each: int = 8) -> str:
    """The first ``wanted`` accepted same-repository draws; ``each`` tries per wanted pair must suffice."""
    return f"""draws AS (SELECT unnest(range(0, {wanted} * {each} + 1000)) AS draw),
picked AS (
  SELECT draw, repo, n_files, {h('file-42-first', 'draw')} % n_files AS i, {h('file-42-second', 'draw')} % (n_files - 1) AS step
  FROM draws JOIN drawable ON repo_no = {h('repo-42', 'draw')} % (SELECT count(*) FROM drawable)),
accepted AS (
  SELECT p.draw, a.file_id AS left_id, b.file_id AS right_id, row_number() OVER (ORDER BY p.draw) - 1 AS place
  FROM picked p
  JOIN slots a ON a.repo = p.repo AND a.idx = p.i
  JOIN slots b ON b.repo = p.repo AND b.idx = (p.i + 1 + p.step) % p.n_files
  WHERE a.content <> b.content),
negatives AS (SELECT draw, left_id, right_id, place FROM accepted WHERE place < {wanted})"""


N_POSITIVE = f"({N_FILES} // 2)"
PAIRS = f"""{POSITIVES}, {REPOS}, {_draws(f"({N_FILES} - {N_POSITIVE})")},
pairs AS (
  SELECT pair_id, left_id, right_id, kind, label FROM positives
  UNION ALL
  SELECT CAST(place + {N_POSITIVE} AS BIGINT), left_id, right_id, 'negative', CAST(0 AS BIGINT) FROM negatives)"""
ANY_REPO = f"""numbered_files AS (SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS idx FROM code_files),
any_draws AS (
  SELECT draw, {h('any-first-42', 'draw')} % {N_FILES} AS i, {h('any-second-42', 'draw')} % {N_FILES} AS j
  FROM (SELECT unnest(range(0, least({N_FILES} // 2, {N_FILES} - 1))) AS draw)),
any_pairs AS (
  SELECT d.draw, a.file_id AS left_id, b.file_id AS right_id
  FROM any_draws d JOIN numbered_files a ON a.idx = d.i JOIN numbered_files b ON b.idx = d.j
  WHERE d.i <> d.j)"""


def _features() -> str:
    columns = []
    for m in METRICS:
        a, b = f"CAST(a.{m} AS DOUBLE)", f"CAST(b.{m} AS DOUBLE)"
        columns.append(f"abs({a} - {b}) AS {m}_diff")
        columns.append(
            f"CASE WHEN {a} + {b} > 0 THEN least({a}, {b}) / greatest({a}, {b} + CAST(0.001 AS DOUBLE)) "
            f"ELSE CAST(1 AS DOUBLE) END AS {m}_ratio"
        )
    return f"""{METRIC_CTES}, {PAIRS},
features AS (
  SELECT p.pair_id, p.label, p.left_id, {", ".join(columns)}
  FROM pairs p JOIN metrics a ON a.file_id = p.left_id JOIN metrics b ON b.file_id = p.right_id)"""


def _split(table: str, key: str, label: str = "label") -> str:
    """``table`` plus is_test: the first ceil(n/5) rows of each label in hash order."""
    return f"""ranked_{table} AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {h('split-42', key)}, {key}) AS hash_rank,
         count(*) OVER (PARTITION BY {label}) AS label_size
  FROM {table}),
split_{table} AS (
  SELECT * EXCLUDE (hash_rank, label_size),
         CASE WHEN hash_rank <= ceil(label_size * CAST(0.2 AS DOUBLE)) THEN 1 ELSE 0 END AS is_test
  FROM ranked_{table})"""


def _scaled(table: str, names: list[str], keys: str, where: str) -> str:
    stats = ", ".join(
        f"avg({n}) AS m_{n}, CASE WHEN max({n}) > min({n}) THEN stddev_pop({n}) ELSE CAST(1 AS DOUBLE) END AS s_{n}"
        for n in names
    )
    values = ", ".join(f"{r6(f'({n} - m_{n}) / s_{n}')} AS {n}" for n in names)
    return f"""SELECT {keys}, {values}
FROM {table} CROSS JOIN (SELECT {stats} FROM {table} {where}) AS stats"""


X_NAMES = [f"x_{i}" for i in range(SIZE)]
WIDE = f"{VECTORS}, wide AS (SELECT row_id, label, {', '.join(f'x[{i + 1}] AS x_{i}' for i in range(SIZE))} FROM vectors)"
GAPPED = f"""{VECTORS}, wide AS (
  SELECT row_id, label, CASE WHEN row_id % 11 <> 0 THEN x[1] END AS x_0,
         {', '.join(f'x[{i + 1}] AS x_{i}' for i in range(1, SIZE))} FROM vectors)"""


# ---- models -----------------------------------------------------------------------------------

SPLIT_VECTORS = f"{VECTORS}, {_split('vectors', 'row_id')}"
FOLDED = f"""folded AS (
  SELECT *, (row_number() OVER (ORDER BY {h('fold-42', 'row_id')}, row_id) - 1) % 5 AS fold FROM vectors)"""


def _knn(test: str, train: str, same: str) -> str:
    return f"""SELECT row_id, label, avg(CAST(near_label AS DOUBLE)) AS score FROM (
    SELECT q.row_id, q.label, t.label AS near_label, row_number() OVER (
      PARTITION BY q.row_id ORDER BY round(list_distance(q.x, t.x), 9), t.row_id) AS place
    FROM {test} q JOIN {train} t ON {same}) WHERE place <= 5 GROUP BY row_id, label"""


def _centroid(test: str, train: str, key: str) -> str:
    """Hard predictions; ``key`` joins a test row's group with the centroids computed for it."""
    return f"""SELECT row_id, label, centroid_label AS score FROM (
    SELECT q.row_id, q.label, c.label AS centroid_label, row_number() OVER (
      PARTITION BY q.row_id ORDER BY round(list_distance(q.x, c.centre), 9), c.label) AS place
    FROM {test} q JOIN (
      SELECT grp, label, list(mean ORDER BY dim) AS centre FROM (
        SELECT grp, label, dim, avg(v) AS mean FROM (
          SELECT {key} AS grp, t.label, unnest(t.x) AS v, generate_subscripts(t.x, 1) AS dim FROM {train}) GROUP BY grp, label, dim)
      GROUP BY grp, label) c ON c.grp = q.grp) WHERE place = 1"""


TEST_ROWS = "test_rows AS (SELECT *, 0 AS grp FROM split_vectors WHERE is_test = 1), train_rows AS (SELECT * FROM split_vectors WHERE is_test = 0)"
OOF = f"""{VECTORS}, {FOLDED}, fold_rows AS (SELECT *, fold AS grp FROM folded),
train_by_fold AS (SELECT f.grp AS held_out, t.* FROM (SELECT DISTINCT fold AS grp FROM folded) f JOIN folded t ON t.fold <> f.grp),
knn_oof AS ({_knn('fold_rows', 'folded', 't.fold <> q.fold')}),
centroid_oof AS ({_centroid('fold_rows', 'train_by_fold t', 't.held_out')}),
oof AS (
  SELECT row_id, label, 'KNeighbors' AS model, score FROM knn_oof
  UNION ALL
  SELECT row_id, label, 'NearestCentroid', CAST(score AS DOUBLE) FROM centroid_oof),
meta AS (
  SELECT row_id, label, max(CASE WHEN model = 'KNeighbors' THEN score END) AS "KNeighbors",
         max(CASE WHEN model = 'NearestCentroid' THEN score END) AS "NearestCentroid"
  FROM oof GROUP BY row_id, label)"""


def _kernel_vote(gamma: str, rows: str) -> str:
    return f"""WITH {rows},
votes AS (
  SELECT q.row_id, q.label, t.label AS vote, exp(-CAST({gamma} AS DOUBLE) * power(list_distance(q.x, t.x), 2)) AS w
  FROM test_rows q JOIN train_rows t ON t.is_test < q.is_test),
shares AS (
  SELECT row_id, label, sum(CASE WHEN vote = 1 THEN w ELSE CAST(0 AS DOUBLE) END) AS one, sum(w) AS total
  FROM votes GROUP BY row_id, label)
SELECT row_id, label, CASE WHEN total > 0 THEN {r6('one / total')} END AS score,
       CAST(CASE WHEN total > 0 AND one / total > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS prediction
FROM shares"""


def _graph() -> str:
    parts = [
        """nodes AS (
  SELECT p_brand AS graph_id, p_partkey AS node, p_retailprice AS x0 FROM part
  UNION ALL SELECT DISTINCT p_brand, -CAST(p_size AS BIGINT) - 1, CAST(0 AS DOUBLE) FROM part),
links AS (
  SELECT p_brand AS graph_id, p_partkey AS src, -CAST(p_size AS BIGINT) - 1 AS dst FROM part
  UNION ALL SELECT p_brand, -CAST(p_size AS BIGINT) - 1, p_partkey FROM part
  UNION ALL SELECT graph_id, node, node FROM nodes),
degrees AS (SELECT graph_id, dst AS node, CAST(count(*) AS DOUBLE) AS degree FROM links GROUP BY graph_id, dst),
s0 AS (SELECT n.graph_id, n.node, n.x0 AS x, d.degree FROM nodes n JOIN degrees d ON n.graph_id = d.graph_id AND n.node = d.node)"""
    ]
    for i in range(3):
        parts.append(
            f"""s{i + 1} AS (
  SELECT l.graph_id, l.dst AS node, sum(a.x / sqrt(a.degree * b.degree)) AS x, b.degree
  FROM links l JOIN s{i} a ON a.graph_id = l.graph_id AND a.node = l.src
  JOIN degrees b ON b.graph_id = l.graph_id AND b.node = l.dst GROUP BY l.graph_id, l.dst, b.degree)"""
        )
    return ", ".join(parts)


# ---- evaluation -------------------------------------------------------------------------------

CELLS = """cells AS (
  SELECT CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS DOUBLE) AS tn FROM scored)"""


def _auc(score: str, where: str = "") -> str:
    """The share of (positive, negative) pairs in the right order, ties counting half."""
    return f"""WITH {SCORED}, s AS (SELECT label, CAST({score} AS DOUBLE) AS v FROM scored {where})
SELECT {r6('''CASE WHEN (SELECT count(DISTINCT label) FROM s) < 2 THEN CAST(0 AS DOUBLE) ELSE (
  SELECT avg(CASE WHEN p.v > n.v THEN CAST(1 AS DOUBLE) WHEN p.v = n.v THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
  FROM s p JOIN s n ON p.label = 1 AND n.label = 0) END''')} AS roc_auc"""


STEPS = f"""{SCORED},
steps AS (
  SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM scored GROUP BY score),
curve AS (
  SELECT score, pos, neg, row_number() OVER w AS step_no,
         CAST(sum(neg) OVER w AS DOUBLE) / (SELECT count(*) FROM scored WHERE label <> 1) AS fpr,
         CAST(sum(pos) OVER w AS DOUBLE) / (SELECT count(*) FROM scored WHERE label = 1) AS tpr,
         lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2
  FROM steps WINDOW w AS (ORDER BY score DESC))"""


def _roc(where: str) -> str:
    return f"""points AS (
  SELECT CAST(0 AS BIGINT) AS point, CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
  UNION ALL
  SELECT CAST(row_number() OVER (ORDER BY score DESC) AS BIGINT), score, fpr, tpr FROM curve {where})"""


KEPT = "WHERE step_no = 1 OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg"
POINT_COLUMNS = f"SELECT point, {r6('threshold')} AS threshold, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM points"
FOLD_SCORES = """fold_scores AS (
  SELECT p_brand AS model, p_partkey % 10 AS fold, p_partkey % 5 AS size,
         CAST(0.5 AS DOUBLE) + CAST(p_partkey % 431 AS DOUBLE) / CAST(1000 AS DOUBLE) AS train_f1,
         CAST(0.5 AS DOUBLE) + CAST(p_partkey % 433 AS DOUBLE) / CAST(1000 AS DOUBLE) AS cv_f1 FROM part)"""


# ---- result analysis --------------------------------------------------------------------------

SCORES = ["accuracy", "balanced_accuracy", "f1_score", "roc_auc"]


def _long(table: str, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{m}' AS metric, {m} AS value FROM {table}" for m in SCORES
    )


def _box(table: str) -> str:
    return f"""long_rows AS ({_long(table, 'model, type')}),
quartiles AS (
  SELECT type, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM long_rows GROUP BY type, metric),
fenced AS (
  SELECT l.*, q1, median, q3, value BETWEEN q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AND q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS inside
  FROM long_rows l JOIN quartiles q ON l.type = q.type AND l.metric = q.metric)"""


def _result_columns(*names: str) -> str:
    text = {"model", "type", "metric"}
    return ", ".join(n if n in text else f"{r6(n)} AS {n}" for n in names)


# ---- tokens -----------------------------------------------------------------------------------


def _encoded(table: str, key: str) -> str:
    words = r"regexp_extract_all(text, '</s>|[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')"
    token = f"CASE WHEN w = '</s>' THEN {END_ID} ELSE {h('token', 'w')} % {VOCABULARY - 4} + 4 END"
    return f"""cut AS (SELECT {key}, list_slice({words}, 1, {MAX_LENGTH - 2}) AS words FROM {table}),
ids AS (
  SELECT {key}, list_concat(list_concat([CAST({START_ID} AS BIGINT)], list_transform(words, lambda w: CAST({token} AS BIGINT))),
         [CAST({END_ID} AS BIGINT)]) AS ids FROM cut)
SELECT {key}, array_to_string(list_concat(ids, list_transform(range(0, {MAX_LENGTH} - len(ids)), lambda z: CAST({PAD_ID} AS BIGINT))), ' ') AS input_ids,
  array_to_string(list_transform(range(0, {MAX_LENGTH}), lambda z: CASE WHEN z < len(ids) THEN 1 ELSE 0 END), ' ') AS attention_mask
FROM ids"""


RENAMES = f"""names AS (
  SELECT p_partkey AS file_id, unnest(list_concat(list_concat(['f', 't', 'x', 'y'],
           CASE WHEN p_partkey % 3 > 0 THEN ['q'] ELSE [] END), CASE WHEN p_partkey % 5 > 0 THEN ['z'] ELSE [] END)) AS old_name
  FROM part WHERE p_partkey % 97 <> 0),
candidates AS (
  SELECT *, translate(substr(md5('42:' || CAST(file_id AS VARCHAR) || ':' || old_name || ':0'), 1, 1), '0123456789', 'ghijklmnop') AS c
  FROM names),
repeated AS (SELECT *, row_number() OVER (PARTITION BY file_id, c ORDER BY old_name) AS n FROM candidates)"""


NEW_NAMES = f"""{RENAMES},
new_names AS (SELECT *, CASE WHEN n > 1 OR c = old_name THEN c || CAST(n AS VARCHAR) ELSE c END AS new_name FROM repeated),
named AS (SELECT file_id, {", ".join(f"coalesce(max(CASE WHEN old_name = '{v}' THEN new_name END), '{v}') AS n_{v}" for v in 'ftxyqz')}
  FROM new_names GROUP BY file_id)"""
PLAIN_NAMES = "named AS (SELECT p_partkey AS file_id, 'f' AS n_f, 't' AS n_t, 'x' AS n_x, 'y' AS n_y, 'q' AS n_q, 'z' AS n_z FROM part)"


def _mutants(with_pass: str, names: str = NEW_NAMES) -> str:
    """The re-printed text of every file: no comments, one blank line before definitions, new names."""
    b = "CASE WHEN p_partkey % 2 = 0 THEN '    ' ELSE '' END"
    return f"""{CODE}, {names},
mutants AS (
  SELECT f.file_id, CASE WHEN f.file_id % 97 = 0 THEN f.content ELSE
      'import os' || chr(10) || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'class K:' || chr(10) || chr(10) ELSE '' END
      || {b} || 'def ' || n_f || '(' || n_x || ', ' || n_y || '):'
      || CASE WHEN {with_pass} THEN chr(10) || {b} || '    pass' ELSE '' END
      || repeat(chr(10) || {b} || '    ' || n_t || ' = ' || n_x || ' + ' || n_y, CAST(1 + p_size % 7 AS INT))
      || repeat(chr(10) || {b} || '    for ' || n_q || ' in ' || n_x || ':' || chr(10) || {b} || '        ' || n_t || ' = ' || n_t || ' * ' || n_q, CAST(p_partkey % 3 AS INT))
      || repeat(chr(10) || {b} || '    if ' || n_y || ':' || chr(10) || {b} || '        ' || n_z || ' = ' || n_x, CAST(p_partkey % 5 AS INT))
      || chr(10) || {b} || '    return ' || n_t END AS content
  FROM code_files f JOIN part p ON p.p_partkey = f.file_id LEFT JOIN named n ON n.file_id = f.file_id)"""


REDUNDANT = f"{h('mutation-42', 'p_partkey')} % 2 = 1"

def _mutant_metrics() -> str:
    base = METRIC_CTES[len(CODE) + 1 :]
    return f"""{_mutants(REDUNDANT)}, {base},
changed AS (
  SELECT m.* REPLACE (
      length(u.content) - length(replace(u.content, chr(10), '')) + 1 AS num_lines, length(u.content) AS chars,
      CASE WHEN ok = 1 THEN 0 ELSE num_comments END AS num_comments)
  FROM m2 m JOIN mutants u ON u.file_id = m.file_id),
mutant_metrics AS (
  SELECT * REPLACE (CAST(chars - (num_lines - 1) AS DOUBLE) / CAST(num_lines AS DOUBLE) AS avg_line_length),
    CASE WHEN ok = 1 THEN greatest(CAST(0 AS DOUBLE),
      (CAST(171 AS DOUBLE) - CAST(5.2 AS DOUBLE) * ln(halstead_volume)
       - CAST(0.23 AS DOUBLE) * CAST(cyclomatic_complexity AS DOUBLE)
       - CAST(16.2 AS DOUBLE) * ln(CAST(num_lines AS DOUBLE))) * CAST(100 AS DOUBLE) / CAST(171 AS DOUBLE))
    ELSE CAST(0 AS DOUBLE) END AS maintainability_index
  FROM changed)"""


def _mixed_features() -> str:
    pairs = PAIRS.replace("pairs AS (", "exact_pairs AS (", 1)
    ctes = _features().split("features AS (", 1)[1].replace("JOIN metrics a", "JOIN all_metrics a").replace("JOIN metrics b", "JOIN all_metrics b")
    return f"""{_mutant_metrics()}, {pairs},
pairs AS (SELECT * REPLACE (CASE WHEN kind = 'exact' AND pair_id % 2 = 1 THEN -left_id - 1 ELSE right_id END AS right_id) FROM exact_pairs),
all_metrics AS (
  SELECT * FROM metrics UNION ALL SELECT * REPLACE (-file_id - 1 AS file_id) FROM mutant_metrics),
features AS ({ctes}"""


def _model_rows() -> str:
    """Test and train rows of the model queries: mixed features, split, scaled on the training side."""
    scaled = _scaled("split_features", FEATURES, "pair_id, label, is_test", "WHERE is_test = 0")
    for f in FEATURES:
        scaled = scaled.replace(r6(f"({f} - m_{f}) / s_{f}"), f"({f} - m_{f}) / s_{f}")
    return f"""{_mixed_features()}, {_split('features', 'pair_id')}, scaled AS ({scaled}),
vectors AS (SELECT pair_id AS row_id, label, is_test, [{', '.join(FEATURES)}] AS x FROM scaled),
test_rows AS (SELECT *, 0 AS grp FROM vectors WHERE is_test = 1), train_rows AS (SELECT * FROM vectors WHERE is_test = 0)"""


def _repeat(nodes: str, times: str) -> str:
    return f"repeat(' {nodes}', CAST({times} AS INT))"


# the breadth-first node types of a rendered file, level by level
SEQUENCES = f"""{METRIC_CTES.split(chr(10) + 'm1 AS', 1)[0]}
sequences AS (
  SELECT file_id, CASE WHEN ok = 0 THEN '' ELSE
      'Module Import ' || CASE WHEN m = 1 THEN 'ClassDef alias FunctionDef' ELSE 'FunctionDef alias' END
      || ' arguments' || {_repeat('Assign', 'a')} || {_repeat('For', 'l')} || {_repeat('If', 'i')} || ' Return'
      || ' arg arg' || {_repeat('Name BinOp', 'a')} || {_repeat('Name Name Assign', 'l')} || {_repeat('Name Assign', 'i')} || ' Name'
      || {_repeat('Store Name Add Name', 'a')} || {_repeat('Store Load Name BinOp', 'l')} || {_repeat('Load Name Name', 'i')} || ' Load'
      || {_repeat('Load Load', 'a')} || {_repeat('Store Name Mult Name', 'l')} || {_repeat('Store Load', 'i')}
      || {_repeat('Load Load', 'l')} END AS sequence
  FROM k),
node_pairs AS (
  SELECT file_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS bigram
  FROM (SELECT file_id, string_split(sequence, ' ') AS w FROM sequences WHERE sequence <> '')),
node_bigrams AS (SELECT file_id, bigram, count(*) AS n FROM node_pairs GROUP BY file_id, bigram)"""


def all_sql() -> dict[str, str]:
    features = _features()
    repo_code = f"{CODE}, {REPOS}"
    sql = {
        # per-file metrics
        "file_line_metrics": f"WITH {CODE} " + _lines("file_id", "content", "code_files"),
        "document_line_metrics": _lines("doc_id", "text", "documents"),
        "code_metrics": f"WITH {METRIC_CTES} SELECT file_id, {_metric_columns()} FROM metrics",
        "parse_failures": "SELECT p_partkey AS file_id FROM part WHERE p_partkey % 97 = 0",
        "node_sequences": f"""WITH {SEQUENCES} SELECT file_id,
  CAST(CASE WHEN sequence = '' THEN 0 ELSE len(string_split(sequence, ' ')) END AS BIGINT) AS n_nodes, sequence FROM sequences""",
        "node_bigrams": f"WITH {SEQUENCES} SELECT file_id, bigram, n FROM node_bigrams",
        "node_bigram_maps": f"""WITH {SEQUENCES}, maps AS (
  SELECT file_id, count(*) AS n_bigrams, '{{' || string_agg('"' || bigram || '":' || CAST(n AS VARCHAR), ',' ORDER BY bigram) || '}}' AS bigrams
  FROM node_bigrams GROUP BY file_id)
SELECT s.file_id, coalesce(n_bigrams, 0) AS n_bigrams, coalesce(bigrams, '{{}}') AS bigrams
FROM sequences s LEFT JOIN maps m ON m.file_id = s.file_id""",
        "word_bigrams": """WITH words AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
pairs AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS bigram FROM words)
SELECT doc_id, bigram, count(*) AS n FROM pairs GROUP BY doc_id, bigram""",
        # repositories and pairs
        "repo_search": """SELECT name, 'repo://' || name || '.git' AS clone_url, stars FROM (
  SELECT c_name AS name, CAST(trunc(c_acctbal) AS BIGINT) AS stars, lower(c_name || ' python cli for ' || c_mktsegment) AS description
  FROM customer WHERE c_custkey % 3 = 0)
WHERE stars > 50 AND contains(description, 'python') AND contains(description, 'cli')
ORDER BY stars DESC, name LIMIT 20""",
        "file_count": "SELECT count(*) AS n_files FROM part",
        "files_per_repo": "SELECT p_brand AS repo, count(*) AS n_files FROM part GROUP BY p_brand",
        "multi_file_repos": f"WITH {repo_code} SELECT repo, n_files, repo_no FROM repo_nos",
        "files_in_repos": f"WITH {repo_code} SELECT file_id, repo, idx FROM slots",
        "positive_pairs": f"WITH {CODE}, {POSITIVES} SELECT * FROM positives",
        "positive_pairs_mixed": f"""WITH {CODE}, {POSITIVES}
SELECT pair_id, left_id, CASE WHEN pair_id % 2 = 1 THEN -left_id - 1 ELSE left_id END AS right_id,
       CASE WHEN pair_id % 2 = 1 THEN 'mutated' ELSE 'exact' END AS kind, label FROM positives""",
        "negatives_same_repo": f"WITH {repo_code}, {_draws(N_FILES)} SELECT draw, left_id, right_id FROM negatives",
        "negatives_nearly_equal": f"""WITH code_files AS ({NEARLY_EQUAL_SQL.format(part='part')}), {REPOS}, {_draws(f"({N_FILES} // 100)", 2000)}
SELECT draw, left_id, right_id FROM negatives""",
        "negatives_any": f"WITH {CODE}, {ANY_REPO} SELECT draw, left_id, right_id FROM any_pairs",
        "pair_set": f"WITH {CODE}, {PAIRS} SELECT * FROM pairs",
        "pair_set_any_repo": f"""WITH {CODE}, {POSITIVES}, {ANY_REPO}
SELECT pair_id, left_id, right_id, kind, label FROM positives UNION ALL
SELECT row_number() OVER (ORDER BY draw) - 1 + {N_POSITIVE}, left_id, right_id, 'negative', CAST(0 AS BIGINT) FROM any_pairs""",
        "class_distribution": f"WITH {CODE}, {PAIRS} SELECT label, count(*) AS n FROM pairs GROUP BY label",
        "dataset_shape": f"WITH {CODE}, {PAIRS} SELECT count(*) AS n_rows, CAST({len(FEATURES)} AS BIGINT) AS n_columns FROM pairs",
        "pair_metric_features": f"WITH {features} SELECT pair_id, label, "
        + ", ".join(f"{r6(f)} AS {f}" for f in FEATURES)
        + " FROM features",
        "pair_text": f"""WITH {CODE}, {PAIRS} SELECT p.pair_id, p.label, a.content || '</s>' || b.content AS text
FROM pairs p JOIN code_files a ON a.file_id = p.left_id JOIN code_files b ON b.file_id = p.right_id""",
        "pair_tokens": f"""WITH {CODE}, {PAIRS}, texts AS (SELECT p.pair_id, a.content || '</s>' || b.content AS text
FROM pairs p JOIN code_files a ON a.file_id = p.left_id JOIN code_files b ON b.file_id = p.right_id), """
        + _encoded("texts", "pair_id"),
        "document_tokens": "WITH " + _encoded("documents", "doc_id"),
        "rename_map": f"""WITH {RENAMES} SELECT file_id, old_name,
       CASE WHEN n > 1 OR c = old_name THEN c || CAST(n AS VARCHAR) ELSE c END AS new_name FROM repeated""",
        "mutation_choice": f"""SELECT p_partkey AS file_id,
       CASE WHEN {h('mutation-42', 'p_partkey')} % 2 = 0 THEN 'rename' ELSE 'redundant' END AS mutation FROM part""",
        "renamed_files": f"WITH {_mutants('FALSE')} SELECT file_id, content FROM mutants",
        "redundant_files": f"WITH {_mutants('TRUE')} SELECT file_id, content FROM mutants",
        "redundant_files_same_names": f"WITH {_mutants('TRUE', PLAIN_NAMES)} SELECT file_id, content FROM mutants",
        "mutated_files": f"WITH {_mutants(REDUNDANT)} SELECT file_id, content FROM mutants",
        "mutant_metrics": f"WITH {_mutant_metrics()} SELECT file_id, {_metric_columns()} FROM mutant_metrics",
        "mixed_pair_features": f"WITH {_mixed_features()} SELECT pair_id, label, "
        + ", ".join(f"{r6(f)} AS {f}" for f in FEATURES)
        + " FROM features",
        "syntax_node_counts": f"""WITH {METRIC_CTES.split(',\nm1 AS', 1)[0]},
per_type AS (SELECT unnest([{', '.join(f"{{'node_type': '{t}', 'n': {e}}}" for t, e in NODE_COUNTS)}]) AS c FROM k WHERE ok = 1)
SELECT c.node_type AS node_type, CAST(sum(c.n) AS BIGINT) AS n FROM per_type GROUP BY c.node_type""",
        # preparation
        "impute_mean": f"""WITH {GAPPED}, {_split('wide', 'row_id')}
SELECT row_id, {', '.join(f"{r6(f'coalesce({n}, m_{n})')} AS {n}" for n in X_NAMES)}
FROM split_wide CROSS JOIN (SELECT {', '.join(f'avg({n}) AS m_{n}' for n in X_NAMES)} FROM split_wide WHERE is_test = 0) AS means""",
        **{
            name: f"SELECT unnest(['bias', {', '.join(repr(f'x_{i}') for i in range(SIZE))}]) AS feature, CAST(0 AS DOUBLE) AS slope"
            for name in ("ridge_slopes", "logistic_slopes", "linear_svc_slopes")
        },
        "extratrees_training_fit": "SELECT count(*) AS n, CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS least_share FROM embeddings",
        "decisiontree_training_fit": "SELECT count(*) AS n, CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS least_share FROM embeddings",
        "exact_cuts": EXACT_CUTS,
        "lgbm_training_loss": "SELECT CAST(range AS BIGINT) AS round, CAST(1 AS BIGINT) AS falls FROM range(1, 6)",
        "lgbm_leaf_counts": "SELECT CAST(31 AS BIGINT) AS leaves, count(*) AS n, CAST(0 AS BIGINT) AS differing FROM lineitem",
        "nan_to_num": f"""WITH {VECTORS} SELECT row_id,
  CASE row_id % 11 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN round(CAST('1.7976931348623157e308' AS DOUBLE) / CAST(1e300 AS DOUBLE), 6)
    WHEN 2 THEN round(CAST('-1.7976931348623157e308' AS DOUBLE) / CAST(1e300 AS DOUBLE), 6) ELSE round(x[1], 6) END AS x_0,
  """ + ", ".join(f"round(x[{i + 1}], 6) AS x_{i}" for i in range(1, SIZE)) + " FROM vectors",
        "standard_scale": f"WITH {features} " + _scaled("features", FEATURES, "pair_id, label", ""),
        "scale_on_train": f"WITH {features}, {_split('features', 'pair_id')} "
        + _scaled("split_features", FEATURES, "pair_id, label, CAST(is_test AS BIGINT) AS is_test", "WHERE is_test = 0"),
        "scale_embeddings": f"WITH {WIDE}, {_split('wide', 'row_id')} "
        + _scaled("split_wide", X_NAMES, "row_id, label, CAST(is_test AS BIGINT) AS is_test", "WHERE is_test = 0"),
        "stratified_split": f"WITH {SCORED}, {_split('scored', 'row_id')} SELECT row_id, label, CAST(is_test AS BIGINT) AS is_test FROM split_scored",
        "aligned_split": f"WITH {CODE}, {PAIRS}, {_split('pairs', 'pair_id')} SELECT pair_id, label, CAST(is_test AS BIGINT) AS is_test FROM split_pairs",
        "grouped_split": f"""WITH {CODE}, {PAIRS}, lefts AS (SELECT DISTINCT left_id, 1 AS one FROM pairs), {_split('lefts', 'left_id', 'one')}
SELECT p.pair_id, p.left_id, CAST(s.is_test AS BIGINT) AS is_test FROM pairs p JOIN split_lefts s ON s.left_id = p.left_id""",
        "kfold5": f"WITH {VECTORS}, {FOLDED} SELECT row_id, CAST(fold AS BIGINT) AS fold FROM folded",
        "stratified_fold10": f"""WITH {SCORED} SELECT row_id, label,
       CAST(ntile(10) OVER (PARTITION BY label ORDER BY row_id) - 1 AS BIGINT) AS fold FROM scored""",
        "learning_curve_subsets": f"""WITH {VECTORS}, {FOLDED},
training AS (SELECT t.row_id, f.fold AS held_out FROM folded t JOIN (SELECT DISTINCT fold FROM folded) f ON f.fold <> t.fold),
ranked AS (
  SELECT row_id, held_out, row_number() OVER (PARTITION BY held_out ORDER BY {h('subset-42', 'row_id')}, row_id) - 1 AS i,
         count(*) OVER (PARTITION BY held_out) AS n FROM training)
SELECT row_id, CAST(held_out AS BIGINT) AS held_out, CAST(CASE
  WHEN i < floor(n * CAST(0.1 AS DOUBLE)) THEN 0 WHEN i < floor(n * CAST(0.325 AS DOUBLE)) THEN 1
  WHEN i < floor(n * CAST(0.55 AS DOUBLE)) THEN 2 WHEN i < floor(n * CAST(0.775 AS DOUBLE)) THEN 3 ELSE 4 END AS BIGINT) AS size_no
FROM ranked""",
        # models and stacking
        "nearest_centroid": f"""WITH {SPLIT_VECTORS}, {TEST_ROWS}, c AS ({_centroid('test_rows', 'train_rows t', '0')})
SELECT row_id, label, {r6('score')} AS score, CAST(score AS BIGINT) AS prediction FROM c""",
        "knn5": f"""WITH {SPLIT_VECTORS}, {TEST_ROWS}, n AS ({_knn('test_rows', 'train_rows', 't.is_test < q.is_test')})
SELECT row_id, label, {r6('score')} AS score, CAST(score > 0.5 AS BIGINT) AS prediction FROM n""",
        "kernel_vote": _kernel_vote("0.05", f"{SPLIT_VECTORS}, {TEST_ROWS}"),
        "kernel_vote_narrow": _kernel_vote("20", f"{SPLIT_VECTORS}, {TEST_ROWS}"),
        "graph_propagate": f"WITH {_graph()} SELECT graph_id, node, {r6('x')} AS x FROM s3",
        "graph_pool": f"WITH {_graph()} SELECT graph_id, {r6('avg(x)')} AS x FROM s3 GROUP BY graph_id",
        "oof_scores": f"WITH {OOF} SELECT row_id, label, model, {r6('score')} AS score FROM oof",
        "meta_features": f"""WITH {OOF} SELECT row_id, label, {r6('"KNeighbors"')} AS "KNeighbors",
       {r6('"NearestCentroid"')} AS "NearestCentroid" FROM meta""",
        "meta_features_imputed": f"""WITH {OOF},
gapped AS (SELECT row_id, label, CASE WHEN row_id % 7 <> 0 THEN "KNeighbors" END AS k, "NearestCentroid" AS c FROM meta)
SELECT row_id, label, {r6('coalesce(k, (SELECT avg(k) FROM gapped))')} AS "KNeighbors", {r6('c')} AS "NearestCentroid" FROM gapped""",
        "stack_combos": f"""WITH {RESULTS}, t AS (SELECT DISTINCT type FROM results)
SELECT a.type || ', ' || b.type || ', ' || c.type AS base_classifiers, m.type AS meta_classifier
FROM t a JOIN t b ON a.type < b.type JOIN t c ON b.type < c.type
JOIN t m ON m.type <> a.type AND m.type <> b.type AND m.type <> c.type""",
        "best_stack": f"""WITH {RESULTS}, top AS (SELECT * FROM results ORDER BY f1_score DESC, seq LIMIT 1)
SELECT 'MetaClassifier (m0-' || CAST(seq % 3 AS VARCHAR) || ', m1-' || CAST(seq % 4 AS VARCHAR) || ', m2-' || CAST(seq % 5 AS VARCHAR) || ')' AS model,
       'Meta-Classifier' AS type, {_result_columns('accuracy', 'balanced_accuracy', 'roc_auc', 'f1_score', 'time_ms')} FROM top""",
        "fit_nearestcentroid": f"""WITH {_model_rows()}, c AS ({_centroid('test_rows', 'train_rows t', '0')})
SELECT row_id, label, CAST(score AS DOUBLE) AS score, CAST(score AS BIGINT) AS prediction FROM c""",
        "fit_kneighbors": f"""WITH {_model_rows()}, n AS ({_knn('test_rows', 'train_rows', 't.is_test < q.is_test')})
SELECT row_id, label, {r6('score')} AS score, CAST(score > 0.5 AS BIGINT) AS prediction FROM n""",
        "fit_labelpropagation": _kernel_vote("20", _model_rows()),
        # evaluation
        "accuracy": f"WITH {SCORED}, {CELLS} SELECT {r6('(tp + tn) / (tp + fn + fp + tn)')} AS accuracy FROM cells",
        "balanced_accuracy": f"WITH {SCORED}, {CELLS} SELECT {r6('(tp / (tp + fn) + tn / (tn + fp)) / 2')} AS balanced_accuracy FROM cells",
        "f1": f"WITH {SCORED}, {CELLS} SELECT {r6('2 * tp / (2 * tp + fp + fn)')} AS f1_score FROM cells",
        "roc_auc": _auc("score"),
        "roc_auc_one_class": _auc("score", "WHERE label = 1"),
        "roc_auc_hard_labels": _auc("prediction"),
        "confusion": f"""WITH {SCORED}
SELECT CAST(l.v AS BIGINT) AS label, CAST(p.v AS BIGINT) AS prediction,
       (SELECT count(*) FROM scored s WHERE s.label = l.v AND s.prediction = p.v) AS n
FROM (VALUES (0), (1)) l(v), (VALUES (0), (1)) p(v)""",
        "roc_points": f"WITH {STEPS}, {_roc(KEPT)} {POINT_COLUMNS}",
        "roc_points_all": f"WITH {STEPS}, {_roc('')} {POINT_COLUMNS}",
        "trapezoid_auc": f"""WITH {STEPS}, {_roc(KEPT)},
strips AS (SELECT (fpr - lag(fpr) OVER (ORDER BY point)) * (tpr + lag(tpr) OVER (ORDER BY point)) / CAST(2 AS DOUBLE) AS s FROM points)
SELECT {r6('sum(s)')} AS area FROM strips""",
        "scores_by_group": f"""WITH {SCORED}, g AS (SELECT d.lang, s.* FROM scored s JOIN documents d ON d.doc_id = s.row_id),
c AS (SELECT lang, count(*) AS n, CAST(count(*) FILTER (WHERE label = prediction) AS DOUBLE) AS hits,
  CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS p,
  CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS q,
  CAST(count(*) FILTER (WHERE prediction = 1) AS DOUBLE) AS said FROM g GROUP BY lang)
SELECT lang, n, {r6('hits / n')} AS accuracy,
  {r6('CASE WHEN p = 0 THEN tn / q WHEN q = 0 THEN tp / p ELSE (tp / p + tn / q) / 2 END')} AS balanced_accuracy,
  {r6('CASE WHEN p + said = 0 THEN 0 ELSE 2 * tp / (p + said) END')} AS f1_score FROM c""",
        "cv_summary": f"""WITH {FOLD_SCORES} SELECT model, {r6('avg(cv_f1)')} AS mean_f1,
       {r6('2 * stddev_pop(cv_f1)')} AS spread_f1 FROM fold_scores GROUP BY model""",
        "learning_curve_summary": f"""WITH {FOLD_SCORES} SELECT model, size, {r6('avg(train_f1)')} AS train_mean,
       {r6('stddev_pop(train_f1)')} AS train_std, {r6('avg(cv_f1)')} AS cv_mean, {r6('stddev_pop(cv_f1)')} AS cv_std
FROM fold_scores GROUP BY model, size""",
        # result analysis
        "result_summary": f"""WITH {RESULTS} SELECT {_result_columns('model', 'type', 'accuracy', 'balanced_accuracy', 'roc_auc', 'f1_score', 'time_ms')}, seq
FROM results ORDER BY f1_score DESC, seq""",
        "top5": f"""WITH {RESULTS}, t AS (SELECT * FROM results ORDER BY f1_score DESC, seq LIMIT 5)
SELECT {_result_columns('model', 'type', 'f1_score', 'accuracy', 'time_ms')} FROM t""",
        "summary_by_type": f"""WITH {RESULTS} SELECT type, {', '.join(
            f"{r6(f'round(avg({m}), 4)')} AS {m}_mean, {r6(f'round(stddev_samp({m}), 4)')} AS {m}_std" for m in ('accuracy', 'f1_score', 'time_ms'))}
FROM results GROUP BY type""",
        "top10_per_metric": f"""WITH {RESULTS}, l AS ({_long('results', 'model, type, seq')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, seq) AS place FROM l)
SELECT metric, place AS rank, model, type, {r6('value')} AS value FROM ranked WHERE place <= 10""",
        "fastest15": f"""WITH {RESULTS}, t AS (SELECT * FROM results ORDER BY time_ms, seq LIMIT 15)
SELECT {_result_columns('model', 'type', 'time_ms')} FROM t""",
        "metric_matrix": f"""WITH {RESULTS}, t AS (SELECT * FROM results ORDER BY seq LIMIT 15)
SELECT {_result_columns('model', *SCORES)} FROM t""",
        "radar": f"""WITH {RESULTS}, t AS (SELECT * FROM results ORDER BY f1_score DESC, seq LIMIT 5), l AS ({_long('t', 'model')})
SELECT model, metric, {r6('value')} AS value FROM l""",
        "type_boxstats": f"""WITH {RESULTS}, {_box('results')}
SELECT type, metric, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
  {r6('min(value) FILTER (WHERE inside)')} AS whisker_low, {r6('max(value) FILTER (WHERE inside)')} AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM fenced GROUP BY type, metric, q1, median, q3""",
        "type_outliers": f"""WITH {RESULTS}, skewed AS (
  SELECT * REPLACE (CASE WHEN seq % 101 = 0 THEN accuracy * 9 ELSE accuracy END AS accuracy) FROM results), {_box('skewed')}
SELECT type, metric, model, {r6('value')} AS value FROM fenced WHERE NOT inside""",
        "types": f"WITH {RESULTS} SELECT type, min(seq) AS first_seq FROM results GROUP BY type",
    }
    return sql
