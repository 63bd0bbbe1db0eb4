"""The one place where source text is parsed: files in, syntax-node arrays out.

``parse_files`` keeps one row per file with parallel arrays (node type, parent,
name, context, depth), so every per-file metric is a narrow JVM-side expression
and nothing is shuffled.  ``ast_nodes`` is the exploded long form.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonelens.functions.arrays import text_slices
from clonelens.functions.skew import shuffled_join
from clonelens.session import spread

NODE_FIELDS = [
    T.StructField("node_type", T.ArrayType(T.StringType())),
    T.StructField("parent", T.ArrayType(T.IntegerType())),
    T.StructField("name", T.ArrayType(T.StringType())),
    T.StructField("ctx", T.ArrayType(T.StringType())),
    T.StructField("def_depth", T.ArrayType(T.IntegerType())),
]
NODE_COLUMNS = [f.name for f in NODE_FIELDS]
_REMEMBERED = 1 << 17  # syntax nodes of parsed texts a task remembers
# contexts of names that are not Name nodes: a function's own name, its positional arguments
DEF, ARG = "def", "arg"


def syntax_columns(text: str | None) -> tuple:
    """Breadth-first node columns of one source text; all None if it does not parse.

    Depth counts the enclosing function and class definitions, the node itself
    included; async definitions, loops and branches do not deepen.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except Exception:  # syntax errors, NUL bytes, nesting beyond the parser's limits
        return (None,) * 5
    queue = [(tree, -1, 0)]
    positional = set()
    kinds, parents, names, contexts, depths = [], [], [], [], []
    for at, (node, parent, depth) in enumerate(queue):
        kind = type(node).__name__
        name = ctx = None
        if kind == "Name":
            name, ctx = node.id, type(node.ctx).__name__
        elif kind == "FunctionDef":
            name, ctx = node.name, DEF
            positional.update(id(a) for a in node.args.args)
        elif kind == "arg" and id(node) in positional:
            name, ctx = node.arg, ARG
        if kind in ("FunctionDef", "ClassDef"):
            depth += 1
        kinds.append(kind)
        parents.append(parent)
        names.append(name)
        contexts.append(ctx)
        depths.append(depth)
        queue.extend((child, at, depth) for child in ast.iter_child_nodes(node))
    return kinds, parents, names, contexts, depths


def _parse_batches(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    seen: dict = {}  # copies of a text that stand close together are parsed once
    held = 0
    for batch in text_slices(batches, "content"):
        if held > _REMEMBERED:
            seen, held = {}, 0
        rows = []
        for text in batch.column("content").to_pylist():
            if text not in seen:
                seen[text] = syntax_columns(text)
                held += len(seen[text][0] or ()) + 1
            rows.append(seen[text])
        columns = list(batch.columns)
        for field in fields:
            at = NODE_COLUMNS.index(field.name)
            columns.append(pa.array([r[at] for r in rows], type=field.type))
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *fields.names])


_ARROW_FIELDS = pa.schema(
    [
        ("node_type", pa.list_(pa.string())),
        ("parent", pa.list_(pa.int32())),
        ("name", pa.list_(pa.string())),
        ("ctx", pa.list_(pa.string())),
        ("def_depth", pa.list_(pa.int32())),
    ]
)


def parse_files(code_files: DataFrame, wanted: Sequence[str] = tuple(NODE_COLUMNS)) -> DataFrame:
    """``code_files`` plus the ``wanted`` node columns; NULL columns where a file does not parse."""
    fields = pa.schema([f for f in _ARROW_FIELDS if f.name in wanted])

    def parse(batches):
        return _parse_batches(batches, fields)

    schema = T.StructType([*code_files.schema.fields, *[f for f in NODE_FIELDS if f.name in wanted]])
    return spread(code_files).mapInArrow(parse, schema)


def ast_nodes(code_files: DataFrame) -> DataFrame:
    """One row per syntax node: (file_id, bfs, parent, node_type, name, ctx, def_depth).

    Node names follow the Python version of the executors, so it is kept as
    ``python_version``.  Files that do not parse have no rows.
    """
    parsed = parse_files(code_files.select("file_id", "content")).drop("content")
    zipped = parsed.select("file_id", F.posexplode(F.arrays_zip(*NODE_COLUMNS)).alias("bfs", "n"))
    return zipped.select(
        "file_id",
        "bfs",
        *[F.col("n")[c].alias(c) for c in NODE_COLUMNS],
        F.lit("%d.%d" % sys.version_info[:2]).alias("python_version"),
    )


def node_sequences(code_files: DataFrame) -> DataFrame:
    """(file_id, tokens): node type names in breadth-first order, empty if unparsable."""
    parsed = parse_files(code_files.select("file_id", "content"), ["node_type"])
    empty = F.array().cast("array<string>")
    return parsed.select("file_id", F.coalesce("node_type", empty).alias("tokens"))


def bigram_counts(sequences: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, bigram, n): counts of adjacent 'A_B' in each token array.

    Pairs are built inside the row, so the only shuffle is that of the counted,
    partially aggregated (key, bigram) rows; a long text is never one group.
    """
    last = F.size(tokens) - 1
    pairs = F.zip_with(
        F.slice(F.col(tokens), F.lit(1), F.greatest(last, F.lit(0))),
        F.slice(F.col(tokens), F.lit(2), F.greatest(last, F.lit(0))),
        lambda a, b: F.concat(a, F.lit("_"), b),
    )
    exploded = spread(sequences.select(key, tokens)).select(key, F.explode(pairs).alias("bigram"))
    return exploded.groupBy(key, "bigram").agg(F.count(F.lit(1)).alias("n"))


def bigram_maps(code_files: DataFrame) -> DataFrame:
    """(file_id, bigrams map<string,bigint>) over node types, one row per file."""
    sequences = node_sequences(code_files)
    counted = bigram_counts(sequences, "file_id")
    entries = counted.groupBy("file_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bigram", "n")))).alias("bigrams")
    )
    empty = F.create_map().cast("map<string,bigint>")
    every = shuffled_join(code_files.select("file_id"), entries, "file_id", "left")
    return every.select("file_id", F.coalesce("bigrams", empty).alias("bigrams"))
