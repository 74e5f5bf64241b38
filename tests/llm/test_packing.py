import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from recordsync.llm import packing
from recordsync.llm._common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, share string"


def best_fit(lengths, capacity):
    """Number of sequences of best-fit decreasing, a piece at a time."""
    gaps = []
    for s in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= s]
        if fits:
            i = min(fits, key=gaps.__getitem__)
            gaps[i] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def check_places(rows, capacity):
    """Gapless sequences from 0, none over capacity; returns their number."""
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append((r.offset, r.length))
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of)


def test_one_sweep_equals_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(200):
        capacity = int(rng.integers(2, 60))
        lengths = sorted(rng.integers(1, capacity + 1, rng.integers(0, 120)).tolist(), reverse=True)
        out = packing.sweep(lengths, [1] * len(lengths), list(range(len(lengths))), True, capacity)
        placed = {i: s for what, i, s, *_ in out if what == 0}
        assert sorted(placed) == list(range(len(lengths))) and len(set(placed.values())) == best_fit(lengths, capacity)


LENGTHS = {
    "even": lambda rng: rng.integers(1, 2049, 3000), "short": lambda rng: rng.integers(1, 60, 3000), "middle": lambda rng: rng.integers(300, 900, 3000),
    "skewed": lambda rng: np.clip(rng.lognormal(5.5, 1, 3000).astype(int), 1, 2048), "few": lambda rng: rng.choice([700, 690, 1024, 1025, 340, 100], 3000),
    "equal": lambda rng: np.full(3000, 600), "empty texts": lambda rng: np.concatenate([np.ones(2000, int), rng.integers(1, 2049, 1000)]),
}


@pytest.mark.parametrize(("kind", "range_rows"), [("even", 400), ("short", 400), ("few", 400), ("empty texts", 400), ("middle", 200), ("skewed", 10**6)])
def test_rounds_over_ranges(spark, kind, range_rows):
    """Every piece once, no sequence over its length, and about as few sequences as best-fit decreasing has."""
    lengths = LENGTHS[kind](np.random.default_rng(2)).tolist()
    table = spark.createDataFrame(list(enumerate(lengths)), "id long, size long").repartition(8)
    rows = packing.assign(table, 2048, range_rows).collect()
    assert sorted(r.id for r in rows) == list(range(len(lengths)))
    held = defaultdict(int)
    for r in rows:
        held[r.sequence] += lengths[r.id]
    assert max(held.values()) <= 2048
    # One more for each range that opens sequences, and one in fifty.
    assert len(held) <= 1.02 * best_fit(lengths, 2048) + 11 * (1 + len(lengths) // range_rows)


def test_ids_of_odd_texts():
    whole, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    rng = random.Random(3)
    odd = ["\u0130", "\u0131", "\u0149", "\u01f0", "\u1e9e", "\u0958", "\u093c", "\u0301", "\u0307", "\u03a3", "\ufb01", "\u2167", "\u00a0", "\u3000", "\u200d", "\u1100", "\u1161", "\x85", "\x1c"]
    chars = [chr(c) for c in range(0x20, 0x600)] + odd * 20 + list("\"'.,!&*") * 20 + ["a", "B", "s"] * 60 + [" ", "\n", "\t"] * 30
    texts = ["".join(rng.choices(chars, k=rng.randint(1, 14))) for _ in range(20000)] + ["\u0130.", "a\u0301,", "X's,'S'", "W\u030a W\u033d\u030a."]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_ids_of_words_equal_ids_of_texts(spark, sf):
    whole = Tokenizer.from_file(PATH)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", " ", "it's\tDON'T\n\n x y z é ́a <|endoftext|>b 'S 12345 ΣΣ \U0001f600!?"]
    for text, ids in zip(texts, packing.WordEncoder(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pack(spark, sf):
    docs = [(r.doc_id, r.text, "l", "s") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(None, None, None, None), (5, "", None, None), (5, "", None, None), (-1, "the word " * 60000, None, None)]
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA), PATH).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, *_ in docs:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    assert check_places(rows, 2048) == best_fit([w[3] for w in want], 2048)
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
