import hashlib

from compare import connect, differences

from clonelens.llm import line_dedup as ld

_LOWER = {c: c + 32 for c in range(65, 91)}
_LAST = float("inf")


def _key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(_LOWER)


def _by_hand(rows):
    """(id, text) -> (n_lines, n_dropped, kept) by the rule, over all pairs of lines."""
    holders = {}
    order = lambda d: _LAST if d is None else d
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(_key(line), set()).add(order(d))
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = _key(line)
            if not (len(k) >= 10 and len(holders[k]) > 1 and order(d) > min(holders[k])):
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_equals_the_rule(documents, odd_documents):
    found = ld.dedup_lines(documents(odd_documents)).select("__row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, found), key=repr) == _by_hand(odd_documents)


def test_a_line_in_most_documents(documents):
    rows = [(i, f"the same licence line\nown line number {i} is long") for i in range(300)] + [(300, "THE SAME licence line ")]
    found = ld.dedup_lines(documents(rows)).select("__row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, found), key=repr) == _by_hand(rows)


def test_columns_pass_through(documents, odd_documents):
    docs = documents(odd_documents)
    out = ld.dedup_lines(docs).select("__row.*")
    assert out.schema == docs.schema
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))


def test_empty_table(documents):
    assert ld.dedup_lines(documents([])).count() == 0


def test_query_equals_sql(spark):
    got = ld.op2_line_dedup(spark, "/root/testdata/sf0.001")
    assert differences(got, connect("0.001"), ld.OP2_SQL) == []


def test_digest_of_a_text_that_lost_all_lines(documents):
    rows = [(1, "one long shared line"), (2, "one long shared line")]
    found = {r["id"]: r["kept"] for r in ld.dedup_lines(documents(rows)).selectExpr("__row.doc_id AS id", "kept").collect()}
    assert found == {1: "one long shared line", 2: ""}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
