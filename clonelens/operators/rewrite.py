"""Mutated clones: consistent renaming and a redundant statement.

A file is parsed once: the same tree gives the names, gets the new ones and is
printed again.  New names come from a seeded hash and are made unique inside the
file, so a mutant needs no shuffle.
"""

from __future__ import annotations

import ast
import hashlib
import keyword
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonelens.functions.arrays import text_slices
from clonelens.functions.hashing import seeded_hash
from clonelens.session import spread

RENAME, REDUNDANT = "rename", "redundant"
# md5 gives hexadecimal digits; decimal digits become the letters after 'f'
_DIGITS, _LETTERS = "0123456789", "ghijklmnop"
_MD5_LENGTH = 32
_TO_LETTERS = str.maketrans(_DIGITS, _LETTERS)


def mutant_id(file_id: Column) -> Column:
    """Ids of mutants are negative, so they never meet an original's id."""
    return -file_id - F.lit(1)


def _candidate(seed: int, file_id: int, name: str) -> str:
    """Lowercase letters of the same length as ``name``."""
    blocks = range((len(name) - 1) // _MD5_LENGTH + 1)
    digest = "".join(hashlib.md5(f"{seed}:{file_id}:{name}:{b}".encode()).hexdigest() for b in blocks)
    return digest[: len(name)].translate(_TO_LETTERS)


def new_names(names: Iterable[str], file_id: int, seed: int) -> dict[str, str]:
    """An injective renaming of a file's names.

    A candidate that repeats, equals the old name or is a keyword gets its
    repeat number as a suffix; candidates hold no digits, so the result is unique.
    """
    out, seen = {}, {}
    for old in sorted(names):
        new = _candidate(seed, file_id, old)
        seen[new] = seen.get(new, 0) + 1
        number = seen[new]
        out[old] = f"{new}{number}" if number > 1 or new == old or keyword.iskeyword(new) else new
    return out


def _parsed(text: str | None) -> list[ast.AST] | None:
    """The nodes of a text breadth-first, None if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return list(ast.walk(ast.parse(text)))
    except Exception:  # syntax errors, NUL bytes, nesting beyond the parser's limits
        return None


def _names(nodes: list[ast.AST]) -> set[str]:
    """Names read or stored, function names and positional arguments; deleted names stay."""
    found = set()
    for node in nodes:
        if isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Del):
            found.add(node.id)
        elif isinstance(node, ast.FunctionDef):
            found.add(node.name)
            found.update(a.arg for a in node.args.args)
    return found


def mutant(text: str, file_id: int, seed: int, rename: bool, add_to: int | None) -> str:
    """Print ``text`` again, with new names if ``rename``.

    With ``add_to``, a ``pass`` opens the body of that function (counted
    breadth-first, modulo their number); without a function the text stays.
    """
    nodes = _parsed(text)
    functions = [n for n in nodes or () if isinstance(n, ast.FunctionDef)]
    if nodes is None or (add_to is not None and not functions):
        return text
    try:
        renames = new_names(_names(nodes), file_id, seed) if rename else {}
        for node in nodes if renames else ():
            if isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Del):
                node.id = renames.get(node.id, node.id)
            elif isinstance(node, ast.FunctionDef):
                node.name = renames.get(node.name, node.name)
                for argument in node.args.args:
                    argument.arg = renames.get(argument.arg, argument.arg)
        if add_to is not None:
            functions[add_to % len(functions)].body.insert(0, ast.Pass())
        return ast.unparse(nodes[0])
    except Exception:  # nesting beyond the printer's limits
        return text


def rename_maps(code_files: DataFrame, seed: int = 42) -> DataFrame:
    """``code_files`` plus ``renames map<string,string>``, see ``new_names``; NULL where a file does not parse."""
    kind = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "content"):
            maps = []
            for text, file_id in zip(batch.column("content").to_pylist(), batch.column("file_id").to_pylist()):
                nodes = _parsed(text)
                maps.append(None if nodes is None else list(new_names(_names(nodes), file_id, seed).items()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maps, kind)], names=[*batch.schema.names, "renames"])

    renames = T.StructField("renames", T.MapType(T.StringType(), T.StringType()))
    return spread(code_files).mapInArrow(run, T.StructType([*code_files.schema.fields, renames]))


def _print_mutants(code_files: DataFrame, seed: int, rename: bool, add_to: Column | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "content"):
            rows = zip(*[batch.column(c).to_pylist() for c in ("content", "file_id", "add_to")])
            printed = [mutant(text, file_id, seed, rename, at) for text, file_id, at in rows]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(printed, pa.string())], names=["file_id", "content"])

    at = F.lit(None).cast("bigint") if add_to is None else add_to
    prepared = code_files.select(F.col("file_id").cast("bigint").alias("file_id"), "content", at.alias("add_to"))
    return spread(prepared).mapInArrow(run, "file_id bigint, content string")


def rename_variables(code_files: DataFrame, seed: int = 42) -> DataFrame:
    """(file_id, content) with every name, function and positional argument renamed."""
    return _print_mutants(code_files, seed, True, None)


def add_redundant_statement(
    code_files: DataFrame, seed: int = 42, also_rename: bool = True
) -> DataFrame:
    """(file_id, content) with a ``pass`` first in one hash-drawn function.

    ``also_rename`` is the default behaviour: the names change as well.
    """
    return _print_mutants(code_files, seed, also_rename, seeded_hash(f"function-{seed}", F.col("file_id")))


def chosen_mutation(file_id: Column, seed: int = 42) -> Column:
    """Which of the two mutations a file gets, with equal odds."""
    even = F.pmod(seeded_hash(f"mutation-{seed}", file_id), F.lit(2)) == 0
    return F.when(even, F.lit(RENAME)).otherwise(F.lit(REDUNDANT))


def mutate_code(code_files: DataFrame, seed: int = 42) -> DataFrame:
    """(file_id, content) after the hash-chosen mutation; unparsable text stays as it is."""
    pick = F.when(
        chosen_mutation(F.col("file_id"), seed) == REDUNDANT,
        seeded_hash(f"function-{seed}", F.col("file_id")),
    )
    return _print_mutants(code_files, seed, True, pick)
