"""Parsing, metrics and the source reader on awkward files."""

import ast

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clonelens.operators import metrics, syntax
from clonelens.operators.pairs import files_per_repo
from clonelens.sources.source_tree import decode_source, number_files, read_source_tree
from clonelens.streaming.arriving_files import arriving_metrics
from clonelens.sources.tables import CODE_FILES, read_json_array, read_table, write_table

FILES = {
    "empty.py": b"",
    "crlf.py": b"x = 1\r\n# c\r\n",
    "bom.py": b"\xef\xbb\xbfx=1",
    "nul.py": b"x = 1\x00",
    "badutf8.py": b'y = "\xff\xe9"',
    "pkg/__init__.py": b"a = 1\n",
    "_priv/b.py": b"b = 2\n",
    ".hid/c.py": b"c = 3\n",
    "async.py": b"async def f():\n    async for i in g():\n        pass\n    return [j for j in k], lambda z: z\n",
    "elif.py": b"if a:\n    pass\nelif b:\n    pass\nelif c:\n    pass\nelse:\n    pass\n",
    "nested.py": b"def f():\n    class A:\n        def g(self):\n            for i in x:\n                while i:\n                    if i:\n                        pass\n",
    "string_hash.py": b'"""\n# inside\n"""\nx = 1  # trailing\n\t# tabbed\n',
    "deep_paren.py": b"(" * 10000 + b"1" + b")" * 10000,
    "deep_minus.py": b"-" * 10000 + b"1",
    "notes.txt": b"not source",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, data in FILES.items():
        path = root / "repo1" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


@pytest.fixture(scope="module")
def files(spark, tree):
    return number_files(read_source_tree(spark, str(tree))).cache()


@pytest.fixture(scope="module")
def measured(files):
    rows = metrics.file_metrics(files).join(files.select("file_id", "path"), "file_id").collect()
    return {r["path"].split("/repo1/")[1]: r for r in rows}


def test_source_finds_every_file(files, tree):
    found = {r["path"].split("/repo1/")[1]: r for r in files.collect()}
    assert set(found) == {n for n in FILES if n.endswith(".py")}
    assert found["crlf.py"]["content"] == "x = 1\n# c\n"
    assert found["badutf8.py"]["content"] == 'y = ""'
    assert found["pkg/__init__.py"]["repo"] == "pkg"
    assert sorted(r["file_id"] for r in found.values()) == list(range(len(found)))


def test_repository_level_root(spark, tree):
    repos = {r["repo"] for r in read_source_tree(spark, str(tree), "root").collect()}
    assert repos == {"repo1"}


def test_unreadable_and_empty_folders(spark, tmp_path):
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere")
    assert read_source_tree(spark, str(tmp_path)).count() == 0


def test_line_metrics(measured):
    assert (measured["empty.py"].num_lines, measured["empty.py"].avg_line_length) == (1, 0.0)
    assert (measured["crlf.py"].num_lines, measured["crlf.py"].num_comments) == (3, 1)
    assert measured["string_hash.py"].num_comments == 2


def test_parse_failures_keep_line_metrics(files, measured):
    broken = {"bom.py", "nul.py", "deep_paren.py", "deep_minus.py"}
    failed = syntax_failures(files)
    assert failed == broken
    for name in broken:
        row = measured[name]
        assert row.num_lines == 1 and row.cyclomatic_complexity == 1
        assert row.num_operands == row.num_operators == row.max_nesting_depth == 0


def syntax_failures(files):
    ids = metrics.parse_failures(files).join(files.select("file_id", "path"), "file_id")
    return {r["path"].split("/repo1/")[1] for r in ids.collect()}


def test_counts(measured):
    row = measured["async.py"]
    assert (row.num_functions, row.num_loops, row.max_nesting_depth) == (0, 0, 0)
    assert measured["elif.py"].num_conditionals == 3
    nested = measured["nested.py"]
    assert (nested.max_nesting_depth, nested.num_loops, nested.num_conditionals) == (3, 2, 1)
    assert (nested.num_functions, nested.num_classes, nested.cyclomatic_complexity) == (2, 1, 4)


SAMPLE = "import os\n\n@d\ndef f(a, *b, c=1, **e):\n    x = lambda q: q + a\n    del x\n    return [i for i in b]\n"


def test_sequence_is_breadth_first(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, "(")], "file_id bigint, content string")
    rows = {r["file_id"]: r["tokens"] for r in syntax.node_sequences(df).collect()}
    assert rows[1] == [type(n).__name__ for n in ast.walk(ast.parse(SAMPLE))]
    assert rows[2] == []


def test_bigrams_match_a_plain_count(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, "(")], "file_id bigint, content string")
    got = {r["file_id"]: r["bigrams"] for r in syntax.bigram_maps(df).collect()}
    kinds = [type(n).__name__ for n in ast.walk(ast.parse(SAMPLE))]
    want = {}
    for a, b in zip(kinds, kinds[1:]):
        want[f"{a}_{b}"] = want.get(f"{a}_{b}", 0) + 1
    assert got[1] == want and got[2] == {}


def test_long_chain_is_parsed(spark):
    text = "x = " + " + ".join(["a"] * 900)
    df = spark.createDataFrame([(1, text)], "file_id bigint, content string")
    assert metrics.file_metrics(df).first()["num_operators"] == 899


def test_metrics_need_no_shuffle(files):
    plan = metrics.file_metrics(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= files._jdf.queryExecution().executedPlan().toString().count("Exchange") + 1


def test_decode():
    assert decode_source(b"a\rb\r\nc\n") == "a\nb\nc\n"


def test_missing_repository_is_default(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "r")], "file_id bigint, repo string")
    assert {tuple(r) for r in files_per_repo(df).collect()} == {("default", 2), ("r", 1)}


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_collected_files_round_trip(spark, files, tmp_path, kind):
    kept = files.select("path", "content", "repo").filter(F.instr("content", "\x00") == 0)
    write_table(kept, f"{tmp_path}/t", kind)
    back = read_table(spark, f"{tmp_path}/t", CODE_FILES, kind)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, kept.collect()))


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"path": "p", "content": "c", "repo": "r"}]')
    assert read_json_array(spark, f"{tmp_path}/a.json", CODE_FILES).first()["path"] == "p"


def test_metrics_of_arriving_files(spark, files, tmp_path):
    kept = files.select("path", "content", "repo")
    write_table(kept, f"{tmp_path}/in", "parquet")
    stream = arriving_metrics(spark, f"{tmp_path}/in", "parquet")
    running = (
        stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True)
        .option("checkpointLocation", f"{tmp_path}/cp").start()
    )
    running.awaitTermination()
    got = {r["path"]: r["num_operands"] for r in spark.table("arrived").collect()}
    want = metrics.file_metrics(files).join(files.select("file_id", "path"), "file_id").collect()
    assert got == {r["path"]: r["num_operands"] for r in want}


def test_ten_thousand_nested_files(spark, tmp_path):
    """Many folders on several levels are each read once, and only paths are ranked."""
    for i in range(10_000):
        folder = tmp_path / f"r{i % 40}" / f"p{i % 400}" / ("deep/_inner" if i % 3 == 0 else "")
        if i < 1200:
            folder.mkdir(parents=True, exist_ok=True)
        folder = folder if folder.exists() else tmp_path / f"r{i % 40}"
        (folder / f"_f{i}.py").write_text(f"x = {i}\n")
    files = number_files(read_source_tree(spark, str(tmp_path), "root")).collect()
    assert len(files) == 10_000 and len({r["content"] for r in files}) == 10_000
    assert [r["file_id"] for r in sorted(files, key=lambda r: r["path"])] == list(range(10_000))
    assert {r["repo"] for r in files} == {f"r{i}" for i in range(40)}


def test_a_large_arrow_batch_is_parsed_in_slices(monkeypatch):
    """A session's batch of 10,000 texts became Python lists all at once; a worker's memory grew with it."""
    from clonelens.functions import arrays

    texts = [f"x{i % 700} = {i}\n" for i in range(3000)] + [None, "", "(", "y = 1  # " + "z" * (3 << 19), "y = 2"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["file_id", "content"])
    monkeypatch.setattr(syntax, "_REMEMBERED", 2000)
    out = list(syntax._parse_batches(iter([batch, batch.slice(0, 0), batch.slice(2990)]), syntax._ARROW_FIELDS))
    assert max(b.num_rows for b in out) <= arrays.SLICE_ROWS
    assert all(b.num_rows == 1 for b in out if max(len(t or "") for t in b.column("content").to_pylist()) > arrays.SLICE_BYTES)
    whole = pa.Table.from_batches(out)
    assert whole.column("file_id").to_pylist() == [*range(len(texts)), *range(2990, len(texts))]
    rows = zip(*[whole.column(c).to_pylist() for c in ("content", *syntax.NODE_COLUMNS)])
    assert all(tuple(found) == syntax.syntax_columns(text) for text, *found in rows)
