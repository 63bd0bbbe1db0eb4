"""The 17 per-file metrics as one narrow projection over parsed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.functions import text
from clonelens.operators.syntax import parse_files

# The metric names in their order.
METRICS = [
    "num_lines",
    "num_functions",
    "num_classes",
    "num_imports",
    "num_variables",
    "num_loops",
    "num_conditionals",
    "max_nesting_depth",
    "avg_line_length",
    "num_comments",
    "cyclomatic_complexity",
    "num_operators",
    "num_operands",
    "vocabulary_size",
    "program_length",
    "halstead_volume",
    "maintainability_index",
]
FRACTIONS = ["avg_line_length", "halstead_volume", "maintainability_index"]
_NAME_CONTEXTS = ("Load", "Store", "Del")


def line_metrics(texts: DataFrame, content: str = "content") -> DataFrame:
    """Add num_lines, avg_line_length and num_comments of a text column."""
    c = F.col(content)
    counted = texts.withColumns(
        {"num_lines": text.num_lines(c), "num_comments": text.num_comments(c)}
    )
    return counted.withColumn("avg_line_length", text.avg_line_length(c, F.col("num_lines")))


def _count(column: str, *values: str) -> Column:
    hits = F.size(F.filter(column, lambda v: v.isin(*values)))
    return F.when(F.col(column).isNull(), 0).otherwise(hits).cast("bigint")


def _distinct_names() -> Column:
    tagged = F.zip_with("name", "ctx", lambda n, c: F.when(c.isin(*_NAME_CONTEXTS), n))
    names = F.array_compact(F.array_distinct(tagged))
    return F.when(F.col("name").isNull(), 0).otherwise(F.size(names)).cast("bigint")


def halstead_volume(program_length: Column, vocabulary: Column) -> Column:
    """length * log2(vocabulary + 1) if both are positive, else 0."""
    volume = program_length.cast("double") * F.log2((vocabulary + 1).cast("double"))
    return F.when((vocabulary > 0) & (program_length > 0), volume).otherwise(F.lit(0.0))


def maintainability_index(volume: Column, complexity: Column, lines: Column) -> Column:
    """The index scaled to 0..100; 0 without volume."""
    # The weights of the index.
    base, w_volume, w_complexity, w_lines = 171.0, 5.2, 0.23, 16.2
    raw = (
        F.lit(base)
        - F.lit(w_volume) * F.ln(volume)
        - F.lit(w_complexity) * complexity
        - F.lit(w_lines) * F.ln(lines.cast("double"))
    )
    scaled = raw * F.lit(100.0) / F.lit(base)
    return F.when(volume > 0, F.greatest(F.lit(0.0), scaled)).otherwise(F.lit(0.0))


def metrics_of_parsed(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Metrics of rows that already carry the node columns; no shuffle.

    A file that does not parse keeps its line metrics; the rest stay 0 and the
    complexity 1.
    """
    counted = line_metrics(parsed).withColumns(
        {
            "num_functions": _count("node_type", "FunctionDef"),
            "num_classes": _count("node_type", "ClassDef"),
            "num_imports": _count("node_type", "Import", "ImportFrom"),
            "num_variables": _count("ctx", "Store"),
            "num_loops": _count("node_type", "For", "While"),
            "num_conditionals": _count("node_type", "If"),
            "max_nesting_depth": F.coalesce(F.array_max("def_depth"), F.lit(0)).cast("bigint"),
            "num_operators": _count("node_type", "BinOp"),
            "num_operands": _count("node_type", "Name"),
            "vocabulary_size": _distinct_names(),
        }
    )
    col = F.col
    derived = counted.withColumns(
        {
            "cyclomatic_complexity": F.lit(1) + col("num_conditionals") + col("num_loops"),
            "program_length": col("num_operators") + col("num_operands"),
        }
    ).withColumn("halstead_volume", halstead_volume(col("program_length"), col("vocabulary_size")))
    index = maintainability_index(
        col("halstead_volume"), col("cyclomatic_complexity"), col("num_lines")
    )
    out = derived.withColumn("maintainability_index", index)
    casts = [col(m).cast("double" if m in FRACTIONS else "bigint").alias(m) for m in METRICS]
    return out.select(*keep, *casts)


def file_metrics(code_files: DataFrame) -> DataFrame:
    """(file_id, 17 metrics) for ``code_files(file_id, content, ...)``: one pass, no shuffle."""
    wanted = ["node_type", "name", "ctx", "def_depth"]
    return metrics_of_parsed(parse_files(code_files.select("file_id", "content"), wanted), ["file_id"])


def parse_failures(code_files: DataFrame) -> DataFrame:
    """Files whose text does not parse."""
    parsed = parse_files(code_files.select("file_id", "content"), ["def_depth"])
    return parsed.filter(F.col("def_depth").isNull()).select("file_id")
