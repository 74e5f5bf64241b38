"""Token alignment against whole texts encoded one by one and links found byte by byte."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from recordsync.llm import align
from recordsync.llm._common import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [
    "plain words of a text", "two  spaces   and more    ", "  leading", "line\n\n  next\n line \n\ttab\t end\n", "x▁y holds the mark", "café naïve 你好 \U0001f600 ok",
    "<|endoftext|> and <s> </s> <unk>", "nul \x00 byte \x1c sep", "no break   wide", "don't they'll I'm 12,345.678 ---- !!!", " ", "   ", "\n", "a", "a ", "ﬁ Å ñ",
    "again again again again", "x" * 3000 + " " + "ab" * 800, "mixed ▁ mark alone", "tail space \n ", None, "",
]


def brute(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) from the definitions."""
    aligner = align.Aligner(A, B)
    linked, out = [], []
    for text in texts:
        want = b" " + (text or "").encode()
        a = aligner.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = aligner.b.encode(text) if text else []
        if not text or any(b"".join(t[i] for i in x) != want for t, x in ((aligner.a_bytes, a), (aligner.b_bytes, b))):
            linked.append(Counter())
            out.append([0, 0, 0, ""])
            continue
        spans = []
        for table, ids in ((aligner.a_bytes, a), (aligner.b_bytes, b)):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at + len(table[i])))
                at += len(table[i])
            spans.append(side)
        owner = [defaultdict(list), defaultdict(list)]
        for k, side in enumerate(spans):
            for n, (_, low, high) in enumerate(side):
                for byte in range(low, high):
                    owner[k][byte] = n
        linked.append(Counter((a[i], b[j]) for i, j in {(owner[0][x], owner[1][x]) for x in range(len(want))}))
        ends = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        said = [[",".join(str(i) for i, low, high in side if start <= low and high <= end) for side in spans] for start, end in zip([0, *ends[:-1]], ends, strict=True)]
        out.append([len(a), len(b), len(ends), hashlib.sha256(";".join("|".join(s) for s in said).encode()).hexdigest()])
    docs = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [(n_a, n_b, n_g, sum(c.values()), sum(m for p, m in c.items() if docs[p] == most[p[0]]), sum(m * docs[p] for p, m in c.items()), sha) for (n_a, n_b, n_g, sha), c in zip(out, linked, strict=True)]


def rows(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


def check(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, n_a int, chunk string").repartition(3)
    want = sorted(((i, *w) for (i, _), w in zip(docs, brute([t for _, t in docs]), strict=True)), key=repr)
    assert rows(align.scores(df, A, B)) == want


def test_odd_texts_ids_and_clashing_columns(spark):
    check(spark, [*((2**60 + i, t) for i, t in enumerate(ODD)), (None, "plain words"), (7, ODD[0]), (7, ODD[0])])


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 20000").collect()]
    check(spark, docs)


def test_small_calls_and_chunks(spark, sf, monkeypatch):
    """Chunks of few documents and many calls give what one chunk gives."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 5000")
    texts = [r.text for r in docs.collect()]
    aligner = align.Aligner(A, B)
    whole, *_ = aligner.align(texts)
    monkeypatch.setattr(align, "_CALL", 40)
    parts, *_ = aligner.align(texts)
    assert all((whole[c] == parts[c]).all() for c in whole)


def test_no_documents(spark):
    assert align.scores(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_postings_round_trip(seed):
    """Sparse and dense bitmaps, several planes, places at the ends."""
    rng = np.random.default_rng(seed)
    entries = {(int(p), int(x)): int(m) for p, x, m in zip(rng.integers(0, 40, 9000), rng.integers(0, 65536, 9000), rng.geometric(0.4, 9000), strict=True)}
    entries |= {(99 + seed, x): 1 + x % 7 for x in range(0, 65536, 1 + seed * 7)} | {(5, 0): 4096, (5, 65535): 1}
    pair, place, links = (np.array(x) for x in zip(*((p, x, m) for (p, x), m in entries.items()), strict=True))
    names, planes = align.postings(pair, place, links)
    row, plane, at = align.set_bits(planes)
    got = Counter()
    for r, k, x in zip(row, plane, at, strict=True):
        got[int(names[r]), int(x)] += 1 << int(k)
    assert got == entries


def test_units_part_where_whole_texts_part():
    """Random mixes of white space and letters: units encoded alone give the whole text's tokens."""
    rng = np.random.default_rng(3)
    aligner, letters = align.Aligner(A, B), [" ", " ", "\n", "\t", "a", "The", "'s", "9", "!", " ", " ", "\x1d", "é"]
    texts = ["".join(rng.choice(letters, rng.integers(1, 25))) for _ in range(400)]
    found, *_ = aligner.align(texts)
    want = brute(texts)
    assert [(*map(int, x[:3]), x[3]) for x in zip(found["n_a"], found["n_b"], found["n_groups"], found["groups_sha256"], strict=True)] == [(*w[:3], w[6]) for w in want]
