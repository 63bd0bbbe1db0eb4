"""Line metrics as built-in string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks str.strip() removes, except the newline.
_BLANK = r"[\t\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
COMMENT_LINE = rf"(?md)^{_BLANK}*#"


def num_lines(content: Column) -> Column:
    """Pieces between newlines: a trailing newline adds one, an empty text has one."""
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def avg_line_length(content: Column, lines: Column) -> Column:
    """Mean length of the ``lines`` lines in code points."""
    return (F.length(content) - (lines - 1)).cast("double") / lines.cast("double")


def num_comments(content: Column) -> Column:
    """Lines whose first non-blank character is a hash sign."""
    return F.regexp_count(content, F.lit(COMMENT_LINE)).cast("bigint")
