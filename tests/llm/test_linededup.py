import numpy as np

from recordsync.llm import linededup

SCHEMA = "doc_id long, text string, line string, h string, n_lines string"


def canon(line):
    return linededup.canonical(line).decode()


def distance(a, b):
    a, b = a.split(), b.split()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def brute(rows, min_words=5, edit_words=10):
    """Kept text by row; every line against all earlier ones."""
    places = sorted(
        {(doc_id is None, doc_id or 0, i, line) for doc_id, text in rows if text is not None for i, line in enumerate(text.split("\n"))}
    )
    earlier, gone = [], set()
    for none, doc_id, i, raw in places:
        line = canon(raw)
        n = len(line.split())
        if n < min_words:
            continue
        if any(line == e or min(n, len(e.split())) >= edit_words and distance(line, e) <= 1 for e in earlier):
            gone.add((none, doc_id, i))
        earlier.append(line)
    return [
        (d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d is None, d or 0, i) not in gone))
        for d, t in rows
    ]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "l", "h", "n") for d, t in rows], SCHEMA)
    out = linededup.deduplicate(df)
    assert set(out.columns) == {"doc_id", "text", "line", "h", "n_lines", "n_dropped"}
    return [(r.doc_id, r.text) for r in out.collect()]


def rows_with_edits(seed=4):
    rng = np.random.default_rng(seed)
    rows, pool = [], []
    for doc in range(60):
        lines = []
        for _ in range(rng.integers(1, 6)):
            kind = rng.integers(0, 5)
            if kind and pool:
                w = list(pool[rng.integers(0, len(pool))])
                at = rng.integers(0, len(w))
                if kind == 1:
                    w[at] = f"x{rng.integers(0, 3)}"
                elif kind == 2:
                    w.insert(at, f"y{rng.integers(0, 3)}")
                elif kind == 3:
                    del w[at]
            else:
                w = [f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 16))]
            pool.append(w or ["z"])
            lines.append(" ".join(w))
        rows.append((doc, "\n".join(lines)))
    return rows


def test_against_all_pairs(spark):
    rows = rows_with_edits()
    assert sorted(run(spark, rows)) == sorted(brute(rows))
    assert sorted(run(spark, rows)) != sorted(rows)


def test_many_variants_of_one_line(spark):
    base = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*base[:5], f"x{i}", *base[6:]])) for i in range(300)] + [(400, " ".join(base[:5] + base[6:]))]
    kept = [r for r in run(spark, rows) if r[1]]
    assert kept == [(0, rows[0][1])]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 277}" for i in range(700))
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, long), (5, long + " end"), (None, long), (6, "Five words are In here"),
        (7, "short\nfive  words are in\there"), (8, "too few words here"), (9, "too few words here"),
    ]
    assert sorted(run(spark, rows), key=str) == sorted(brute(rows), key=str)
    assert run(spark, []) == []
    twice = [(1, "one two three four five"), (1, "one two three four five")]
    assert run(spark, twice) == twice


def test_variant_hashes():
    words = [f"w{i % 7}" for i in range(30)]
    v = linededup.variant_hashes(" ".join(words).encode())
    for i in range(30):
        assert v[i] == linededup.variant_hashes(" ".join(words[:i] + words[i + 1 :]).encode())[-1]


def test_very_long_lines(spark):
    words = [f"w{i % 977}" for i in range(20000)]
    other = [*words[:9000], "changed", *words[9001:]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))]
    assert sorted(run(spark, rows)) == [rows[0], (2, ""), rows[2]]
