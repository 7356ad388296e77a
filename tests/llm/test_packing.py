"""Packing: ids as the library gives them, first fit against a plain search, and what holds for every packing."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kerf.llm import packing

DOCS = "doc_id long, text string, piece long, ids string, length int, sequence_id long"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.tokenizer_path())


def some_texts():
    r = random.Random(8)
    odd = ["a", "B", "é", "é", "́", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "漢", "9", "'s", "'LL", "don't", "<|endoftext|>", "<|startoftext|>", "!?", "İ", "Σ", "\U0001f600", "\0", "﻿", "Word.", "it'S,", "J\u030c", "H\u0331!", "?.", "A;", "..", "É:", "<|ENDOFTEXT|>"]
    plain = ["".join(r.choice(packing.SMALL_LETTERS) for _ in range(r.randint(1, 9))) for _ in range(300)]
    odd += ["Élan", *plain[:20]]
    return ["", " ", *odd, " ".join(plain)] + ["".join(r.choice(odd) for _ in range(r.randint(1, 60))) for _ in range(400)] + ["x" * 300 + " " + "y" * 70]


def test_ids_are_the_library_s(library):
    texts = some_texts()
    coder = packing.Encoder(packing.tokenizer_path())
    for part in (texts[:200], texts[200:], texts):
        got = coder.encode([t.encode() for t in part])
        assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
    assert coder.letters and all(len(w) <= packing.LONGEST_WORD for w in coder.known)


def test_first_fit_is_the_first_bin_with_room():
    r = random.Random(3)
    for n in (0, 1, 2, 3, 17, 64, 65, 500):
        sizes = sorted((r.randint(1, 100) for _ in range(n)), reverse=True)
        room, want = [], []
        for s in sizes:
            at = next((i for i, x in enumerate(room) if x >= s), len(room))
            room += [100] * (at == len(room))
            room[at] -= s
            want.append(at)
        assert packing.first_fit(sizes, 100) == want


@pytest.mark.parametrize("least", [1, 16])
def test_fill_up_keeps_every_id(least):
    r = random.Random(5)
    for n in (0, 1, 2, 9, 200):
        bins = [[(i * 3 + j, 0, r.randint(1, 30)) for j in range(r.randint(1, 3))] for i in range(n)]
        want = sorted((i, x) for b in bins for i, s, k in b for x in range(s, s + k))
        done = packing.fill_up([list(b) for b in bins], 100, least)
        assert sorted((i, x) for b in done for i, s, k in b for x in range(s, s + k)) == want
        for b in done:
            used = sum(k for *_, k in b)
            assert 0 < used <= 100 and (100 - used < least or used & used - 1 == 0)


def checked(rows, want, capacity):
    """Rows of a packing against the ids of each document."""
    whole, places = {}, {}
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and 0 < r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        whole.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert whole.keys() == want.keys()
    for spans, top in [(x, len(want[d])) for d, x in whole.items()] + [(x, None) for x in places.values()]:
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == top if top is not None else at <= capacity
    return [sum(n for _, n in x) for x in places.values()]


def test_pack(spark, library):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    texts = [None, "", " \n", *some_texts()[:60], " ".join(word() for _ in range(9000))] + [" ".join(word() for _ in range(r.randint(1, 900))) for _ in range(150)] + ["the same"] * 300
    docs = spark.createDataFrame([(i, t, 5, "x", 7, 9) for i, t in enumerate(texts)], DOCS).repartition(3)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    packed = packing.Packing(docs, per_group=64)
    rows = packed.table().collect()
    used = checked(rows, want, 2048)
    assert sum(2048 - u for u in used if u & u - 1) <= 16 * len(used)
    # Sequences hold the ids at the places that the table tells.
    sequences = {s["sequence_id"]: s for s in packed.sequences(pad_id=77).collect()}
    assert len(sequences) == len(used)
    for row in rows:
        s, at = sequences[row["sequence_id"]], row["offset"]
        assert s["ids"][at : at + row["length"]] == want[row["doc_id"]][row["start"] : row["start"] + row["length"]]
    for s in sequences.values():
        assert len(s["ids"]) == (s["n_ids"] if s["n_ids"] & s["n_ids"] - 1 == 0 else 2048) and set(s["ids"][s["n_ids"] :]) <= {77}


def test_texts_that_fit_badly_and_repeats(spark, library):
    text = " ".join(["word"] * 1200)
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").repartition(2)
    used = checked(packing.pack(docs).collect(), {i: library.encode(text, add_special_tokens=False).ids + [1] for i in range(40)}, 2048)
    assert sum(2048 - u for u in used if u & u - 1) <= 16 * len(used)
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    rows = packing.pack(twice).collect()
    # 3 + 3 + 3 + 1 ids: sequences of 8 and 2, so a document is cut.
    assert sum(r["length"] for r in rows) == 10 and {r["doc_tokens"] for r in rows} == {1, 3}
    assert sorted(sum(r["length"] for r in rows if r["sequence_id"] == q) for q in {r["sequence_id"] for r in rows}) == [2, 8]


def test_empty_table(spark):
    none = packing.Packing(spark.createDataFrame([], "doc_id string, text string"))
    assert none.table().count() == 0 and none.sequences().count() == 0 and none.table().schema["doc_id"].dataType.simpleString() == "string"
