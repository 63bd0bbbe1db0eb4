import hashlib
import re

from clonelens.llm import private_data as pd_

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def spans_of(spark, docs):
    found = pd_.find_private(docs)
    rows = found.select("__row.doc_id", "__row.text", pd_.listed("base").alias("base"), pd_.listed("spans").alias("spans"))
    return rows.collect()


ODD_TEXTS = [
    "a@b.c.d@e.f", "a@b.c_d@e.f x%y@z.q", "@a.b abc@ abc@@x.y .@-.- a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255",
    "4111 1111-1111 1111", "4111111111111111 4111111111111112 1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
    "+1 (017) 555-7713 ++12 345 678 901, +1234567890123456 +1--2", "ü+49 30 1234567 (8) ) 9é", "1.1.1.1@1.1.1.1",
    "\U0001F600 mail: \U0001F600x@y.zz", "49927398716 79927398713", "+1.2.3.4.5.6.7.8.9.0.1", "0-0 0-0 0-0 0-0 0-0 0-0 0-0",
]


def test_base_spans(spark, documents):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100, None), (101, ""), (None, "x@y.zz"), (1, ODD_TEXTS[1]), (1, ODD_TEXTS[1])]
    for r in spans_of(spark, documents(rows)):
        assert r.base == r.spans == joined(base(r.text)), r.text


def test_long_runs_are_read_once(spark, documents):
    """Texts on which the plain patterns would take the square of their length."""
    addresses = "x@y." * 50_000
    runs = {
        "a" * 300_000: "", "1" * 300_000: "", "1 " * 150_000 + "x": "", "a:" * 100_000 + "g": "", "((((" * 50_000: "",
        "1." * 100_000: ",".join(f"ip:{at}:{at + 7}" for at in range(0, 200_000, 8)),
        addresses: joined(base(addresses)),
    }
    for r in spans_of(spark, documents(list(enumerate(runs)))):
        assert r.base == runs[r.text], r.doc_id


def test_many_matches_in_one_text(spark, documents):
    text = " and ".join(f"user{i}@mail.example.com" for i in range(3000))
    (row,) = spans_of(spark, documents([(1, text)]))
    assert row.base == joined(base(text)) and row.base.count(",") == 2999


SEEDS = [f"my phone is +49 30 555 01 {i:02d} today" for i in range(6)]
ADDRESSES = [f"please write to user{i}@mail.example.com soon" for i in range(6)]


def test_patterns_discover_unseen_identifiers(spark, documents):
    new, elsewhere = "my phone is (030) 555-9876 today", "room 42, (030) 555-9876, nothing else"
    broken = "please write to jürgen@müller today"
    prose = "we like to count to 1234567 and to 7654321 again"
    texts = [*SEEDS, *ADDRESSES, new, elsewhere, broken, prose]
    found = {r.text: r for r in spans_of(spark, documents(list(enumerate(texts))))}
    assert found[new].spans == f"phone:12:{len(new) - 6}"
    assert found[elsewhere].spans == f"phone:9:{len(elsewhere) - 14}" and found[elsewhere].base == ""
    assert found[broken].spans == "email:16:29"
    assert found[prose].spans == ""
    for text in SEEDS + ADDRESSES:
        assert found[text].spans == found[text].base == joined(base(text))


def test_weak_patterns_discover_nothing(spark, documents):
    """Too few different seeds, or a context that mostly precedes other words."""
    rare = [SEEDS[0]] * 50 + SEEDS[:2] + ["my phone is (030) 555-9876 today"]
    assert all(r.spans == r.base for r in spans_of(spark, documents(list(enumerate(rare)))))
    common = [*SEEDS, *["my phone is broken"] * 9, "my phone is (030) 555-9876 today"]
    assert all(r.spans == r.base for r in spans_of(spark, documents(list(enumerate(common)))))


def test_confidence_grows_over_rounds(spark, documents):
    """Instances found by one pattern make a second pattern sure, which finds more."""
    first, second = "(030) 555-7701", "(030) 555-7702"
    texts = [*SEEDS, f"my phone is {first} today"]  # 6 of 7 places
    texts += [f"reach me at +49 30 555 88 {i:02d} please" for i in range(4)]  # 4 of 6, with the first number 5
    texts += [f"reach me at {n} please" for n in (first, second)]
    found = {r.text: r for r in spans_of(spark, documents(list(enumerate(texts))))}
    assert found[f"reach me at {second} please"].spans == "phone:12:26"


def brute_accepted(edges, counts, confident):
    taken = {(k, v) for _, k, v, seed, _ in edges if seed}
    seeds = set(taken)
    while True:
        held = {}
        for context, kind, value, _, n in edges:
            if (kind, value) in taken:
                held[context, kind] = held.get((context, kind), 0) + n
        sure = {(c, k) for (c, k), n in held.items() if c in counts and n >= confident * counts[c]}
        more = {(k, v) for c, k, v, _, _ in edges if (c, k) in sure}
        if more <= taken:
            return taken - seeds
        taken |= more


def test_graph_against_brute_force(spark):
    import random

    rng = random.Random(9)
    edges = sorted({(f"c{rng.randrange(12)}", rng.randrange(2), f"v{rng.randrange(40)}", rng.random() < 0.4) for _ in range(150)})
    edges = [(*e, rng.randrange(1, 4)) for e in edges]
    counts = {f"c{i}": rng.randrange(5, 30) for i in range(11)}
    frame = spark.createDataFrame(edges, "context string, kind int, value string, seed boolean, n bigint")
    places = spark.createDataFrame(list(counts.items()), "context string, places bigint")
    got = {tuple(r) for r in pd_.accepted(frame, places, 0.6, rounds=50).collect()}
    want = brute_accepted(edges, counts, 0.6)
    assert got == want and want


def test_places_and_contexts(spark, documents):
    texts = ["To the\tmoon and to the sun", "to the", "TO the moon", None, ""]
    wanted = spark.createDataFrame([("to the", 0), ("the moon", 0), ("no where", 1)], "context string, kind int")
    rows = documents(list(enumerate(texts))).select("text").fillna("")
    assert {tuple(r) for r in pd_.places(rows, wanted).collect()} == {("to the", 4), ("the moon", 2)}


def test_query(spark, documents, odd_documents, tmp_path):
    documents(odd_documents + [(20, ODD_TEXTS[7]), (21, ODD_TEXTS[0])]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = pd_.op13_private_data(spark, str(tmp_path)).collect()
    assert len(rows) == len(odd_documents) + 2
    by_id = {r.doc_id: r for r in rows}
    for doc_id, text in [(20, ODD_TEXTS[7]), (21, ODD_TEXTS[0])]:
        r = by_id[doc_id]
        want = base(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in want) for kind in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()


def test_empty_table(spark, documents):
    assert spans_of(spark, documents([])) == []
