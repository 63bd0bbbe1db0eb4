import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from clonelens.llm import packing as p


@pytest.fixture(scope="module")
def definition():
    return p.default_tokenizer()


def test_ids_equal_the_tokenizer_on_odd_texts(definition):
    quick, whole = p.WordTokenizer(definition, "<u2"), p.WholeTokenizer(definition, "<u2")
    rng = random.Random(3)
    letters = "abcXYZ 0123é́ßİΣς '’  \x1c\x85\x00\x7f​½²Ⅷ٣漢字🙂!?-_.,#|<>&\n\tﬁKİ́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", "don't <|endoftext|> 0 00 '0'", "the,, the... THE"]
    for text in texts:
        assert quick.ids(text.encode()) == whole.ids(text.encode()), repr(text)


def test_special_tokens_in_a_text_equal_the_plain_call(definition):
    from tokenizers import Tokenizer

    plain, quick = Tokenizer.from_str(definition), p.WordTokenizer(definition, "<u2")
    for text in ("hello <|endoftext|> there", "a<|startoftext|>b <|ENDOFTEXT|> c", "<|endoftext|><|endoftext|>", "<|EndOfText|>", "no"):
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(quick.ids(text.encode()), "<u2").tolist() == want, text
    assert 49407 in plain.encode("<|endoftext|>", add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(definition, monkeypatch):
    whole = p.WholeTokenizer(definition, "<u2")
    monkeypatch.setattr(p, "_CACHED", 5)
    quick = p.WordTokenizer(definition, "<u2")
    text = " ".join(f"word{chr(97 + i % 26)}{'xyz'[i % 3] * (i % 7)}" for i in range(200))
    for _ in range(3):
        assert quick.ids(text.encode()) == whole.ids(text.encode())


def test_hilbert_neighbours_are_next_to_each_other():
    points = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = p.hilbert_keys(points, bits=3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("capacity", [64, 4096])
def test_every_id_is_in_one_piece(documents, odd_documents, definition, capacity):
    rows = [r for r in odd_documents if r[0] != 4] + [(20 + i, f"word {i} of some text " * i) for i in range(40)]
    pieces = p.pack(documents(rows), definition, capacity).collect()
    whole = p.WholeTokenizer(definition, "<u4")
    want = {d: whole.ids((t or "").encode()) + np.array([2], "<u4").tobytes() for d, t, *_ in rows if d is not None}
    got: dict = {}
    for r in sorted(pieces, key=lambda r: (r["__d"], r["start"])):
        if r["__d"] == p.NO_ID:
            continue
        assert len(got.get(r["__d"], b"")) == 4 * r["start"] and r["doc_tokens"] * 4 == len(want[r["__d"]])
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        got[r["__d"]] = got.get(r["__d"], b"") + r["ids"]
    assert got == want
    filled: dict = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(filled) == list(range(len(filled)))
    assert [n for s, n in filled.items() if n != capacity and s != max(filled)] == []


def test_sequences_hold_the_pieces(documents, definition):
    pieces = p.pack(documents([(1, "one two three"), (2, "four five")]), definition, 4)
    rows = sorted(p.sequences(pieces, 4).collect())
    assert sum(len(r["ids"]) // 4 for r in rows) == sum(r["length"] for r in pieces.collect())
    assert [r["n_pad"] for r in rows][:-1] == [0] * (len(rows) - 1)


def test_repeated_rows_are_packed_repeatedly(documents, definition):
    pieces = p.pack(documents([(1, "one two"), (1, "one two"), (None, None)]), definition)
    assert sorted(r["doc_tokens"] for r in pieces.collect()) == [1, 3, 3]


def test_empty_table(documents, definition):
    assert p.pack(documents([]), definition).count() == 0


def test_new_words_of_several_texts_are_tokenized_together(monkeypatch):
    """A call per text with a new word cost more than the words; the ids stay those of the library."""
    definition = p.default_tokenizer()
    words, whole = p.WordTokenizer(definition, "<u4"), p.WholeTokenizer(definition, "<u4")
    calls = []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new: calls.append(len(new)) or learn(new))
    texts = [f"word{i} na\u00efve-{i} \u4e00\u4e8c x{'y' * (i % 7)}! it's \u00bd".encode() for i in range(100)]
    words.learn(texts)
    assert [words.ids(t) for t in texts] == [whole.ids(t) for t in texts]
    assert len(calls) == 1


def test_words_of_latin_letters_take_the_quick_way(definition, monkeypatch):
    """Accented words went through the whole tokenizer; its Unicode steps do not change them."""
    quick, whole = p.WordTokenizer(definition, "<u2"), p.WholeTokenizer(definition, "<u2")
    slow = []
    others = quick._others
    monkeypatch.setattr(quick, "_others", lambda words: slow.extend(words) or others(words))
    letters = [chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130)]
    assert all(c.isalpha() for c in letters)
    texts = [f"{a}{b}x{a}, {a} {b}\t{a}é!?" for a in letters for b in "é" + letters[-1]]
    assert [quick.ids(t.encode()) for t in texts] == [whole.ids(t.encode()) for t in texts] and not slow
    odd = ["ı̇ É's Ã© é \xa0Ã\xa0 ×÷ İx é Å K ŉ ﬁ"]
    assert [quick.ids(t.encode()) for t in odd] == [whole.ids(t.encode()) for t in odd]


def test_a_word_of_several_texts_is_looked_up_once(definition):
    words, whole = p.WordTokenizer(definition, "<u2"), p.WholeTokenizer(definition, "<u2")
    texts = ["", " ", " the cat\x0b\x0csat ", "a<|endoftext|>b the", "\x1cthe\x85cat", "the " * 50, "the cat"] * 3
    arrow = pa.array(["left out", *texts], pa.string())[1:]
    assert words.every(arrow) == [whole.ids(t.encode()) for t in texts] and words.every(arrow[:0]) == []
