import numpy as np

from recordsync.llm import decontam
from recordsync.llm._common import words_of

SCHEMA = "doc_id long, text string, item_id string, score string"


def slow_align(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        old, row[0] = row[0], 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], max(0, old + (1 if x == y else -1), row[j] - 1, row[j - 1] - 1)
        best = max(best, *row)
    return best


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(1, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 40))
        assert decontam.align(a, b)[0] == slow_align(a.tolist(), b.tolist())


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.2, n) % 3000)
    items = [(i, text(int(rng.integers(15, 60)))) for i in range(30)]
    docs, leaked = [], set()
    for d in range(200):
        body = text(150).split()
        if d % 4 == 0:
            i = int(rng.integers(0, 30)) if d % 8 else 7
            w = items[i][1].split()
            for at in rng.integers(0, len(w), len(w) // 10):
                w[at] = "edited"
            body[60:60] = [x.upper() + "," for x in w]
            leaked.add((d, i))
        docs.append((d, " ".join(body), "i", "s"))
    return docs, items, leaked


def test_leaks_against_all_pairs(spark):
    docs, items, leaked = corpus()
    bench = spark.createDataFrame([*items, (None, None), (99, ""), (98, "one two")], "item_id long, text string")
    got = decontam.leaks(spark.createDataFrame(docs, SCHEMA), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaked and len(got) == len(leaked)
    for r in got:
        a, b = words_of(dict(items)[r.item_id]), words_of(docs[r.doc_id][1])
        assert round(r.score * len(a)) == slow_align(a, b) == slow_align(a, b[r.first_word : r.last_word + 1])
        assert b[r.first_word] == a[0] or r.score < 1
    all_pairs = {(d, i) for d, t, *_ in docs for i, x in items if 2 * slow_align(words_of(x), words_of(t)) >= len(words_of(x))}
    assert all_pairs == leaked
    left = decontam.decontaminate(spark.createDataFrame(docs, SCHEMA), bench)
    assert {r.doc_id for r in left.collect()} == set(range(200)) - {d for d, _ in leaked}


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    long = "x " * 200000 + "alpha beta gamma delta epsilon"
    docs = [(None, long, None, None), (1, None, None, None), (2, "", None, None), (3, "alpha", None, None), (None, None, None, None), (4, long, "a", "b"), (4, long, "a", "b")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = [(r.doc_id, r.item_id, r.score, r.first_word) for r in decontam.leaks(df, bench).collect()]
    assert sorted(got, key=str) == [(4, 1, 1.0, 200000)] * 2 + [(None, 1, 1.0, 200000)]
    assert sorted([r.doc_id for r in decontam.decontaminate(df, bench).collect()], key=str) == [1, 2, 3, None]
    assert decontam.leaks(df, bench.where("false")).count() == 0
    assert decontam.leaks(df.where("false"), bench).count() == 0


def edited_copies():
    """Items of 16 to 60 words, each with every 4th to 6th word replaced, left out or preceded by a new one; a tail of clean words."""
    rng = np.random.default_rng(5)
    new = lambda: f"n{rng.integers(0, 10**9)}"
    items = [(i, " ".join(f"w{i}x{x}" if x % 3 else f"c{x}" for x in range(n))) for i, n in enumerate([16, 25, 40, 41, 60])]
    texts = []
    for _, item in items:
        for step in (3, 4, 5, 6):
            for edit in ("replace", "drop", "insert", "mixed"):
                w = []
                for k, x in enumerate(item.split()):
                    how = edit if edit != "mixed" else ["replace", "drop", "insert"][k // step % 3]
                    w += [x] if k % step != step - 1 else {"replace": [new()], "drop": [], "insert": [new(), x]}[how]
                texts.append(" ".join([new() for _ in range(30)] + w + [new() for _ in range(30)]))
        texts.append(" ".join(y for k, x in enumerate(item.split()) for y in ([new(), x] if k and k % 2 == 0 else [x])))
    return items, texts


def test_heavily_edited_copies_against_all_pairs(spark):
    items, texts = edited_copies()
    want = {(d, i): s for d, t in enumerate(texts) for i, x in items if 2 * (s := slow_align(words_of(x), words_of(t))) >= len(words_of(x))}
    assert any(2 * kept_grams(items[i][1], texts[d]) < len(items[i][1].split()) - 2 for d, i in want)
    whole = [(len(texts) + k, t) for k, (_, t) in enumerate(items)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for times, more in ((1, []), (1, whole), (60, whole * 20)):
        rows = [(d, t, "i", "s") for d, t in [*enumerate(texts)] * times + more]
        got = decontam.leaks(spark.createDataFrame(rows, SCHEMA).repartition(8), bench).collect()
        found = {(r.doc_id, r.item_id): round(r.score * len(items[r.item_id][1].split())) for r in got if r.doc_id < len(texts)}
        assert found == want and sum(r.doc_id < len(texts) for r in got) == times * len(want)
        assert {(r.doc_id, r.score) for r in got if r.doc_id >= len(texts)} == {(d, 1.0) for d, _ in more}


def kept_grams(item, text):
    a, b = item.split(), text.split()
    there = {tuple(b[k : k + 3]) for k in range(len(b) - 2)}
    return sum(tuple(a[k : k + 3]) in there for k in range(len(a) - 2))


def test_recall_by_share_of_edited_words(spark):
    """Copies of random items with 10, 20 and 25 % of their words replaced, left out or put in, between common words."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.zipf(1.3, n) % 4000]
    items = [(i, word(int(rng.integers(12, 70)))) for i in range(40)]
    texts, planted = [], []
    for share in (0.1, 0.2, 0.25):
        for i, item in items:
            out = []
            for x in item:
                how = rng.integers(0, 3) if rng.random() < share else 3
                out += [[word(1)[0]], [], [word(1)[0], x], [x]][how]
            texts.append(" ".join(word(40) + out + word(40)))
            planted.append((share, i))
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if 2 * slow_align([w.encode() for w in x], words_of(t)) >= len(x)}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    got = decontam.leaks(spark.createDataFrame([(d, t, "i", "s") for d, t in enumerate(texts)], SCHEMA), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for share, least in ((0.1, 0.97), (0.2, 0.9), (0.25, 0.75)):
        mine = [(d, i) in want for d, (s, i) in enumerate(planted) if s == share]
        assert np.mean(mine) >= least, share


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", 5, 6, 7), (2, "other text", 5, 6, 7)], "doc_id long, text string, leak int, LEAK_ int, _bad int")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "other text", 5, 6, 7)]
