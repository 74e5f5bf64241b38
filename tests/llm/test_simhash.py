import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from recordsync.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node string"


def brute(rows, k=3, distance=2):
    """Fingerprint and smallest reachable id by row, all pairs compared."""
    fps = []
    for _, text, *_ in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            root[find(i)] = find(j)
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, fps[i], min(ids, default=None)))
    return sorted(out, key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(((r.doc_id, r.fp[0] % 2**64, r.component_id) for r in simhash.near_groups(df, **how).collect()), key=str)


ODD = [
    (5, "a b c", "x", None), (4, "A B\tC", None, "y"), (None, None, None, None), (9, "", None, None), (3, "  \n", None, None),
    (7, "one", None, None), (7, "one", None, None), (7, "one", None, None), (None, "only null ids here at all", None, None),
    (11, "é ß word " * 30000, None, None), (12, "é ß word " * 30000 + "x", None, None),
]


def test_odd_rows(spark):
    assert got(spark, ODD) == brute(ODD)


def test_empty(spark):
    assert got(spark, []) == []


def test_real_documents(spark, sf):
    rows = [(r.doc_id, r.text, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_links_of_near_fingerprints(spark, heavy):
    """All links within two bits are found, by the common way and by that for heavy buckets."""
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 2**63))
    fps = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (60, 2))}
    fps |= {int(x) for x in rng.integers(0, 2**63, 100)}
    rows = [(f, [f], [f >> 32, f & 0xFFFFFFFF]) for f in sorted(fps)]
    nodes = spark.createDataFrame(rows, "node long, fp array<long>, segments array<long>")
    from recordsync.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(nodes, 2, [1, 0], 32, heavy)).collect()}
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(b)] = find(a)
    want = {}
    for f in fps:
        want.setdefault(find(f), []).append(f)
    assert {f: min(group) for group in want.values() if len(group) > 1 for f in group} == roots


def near_copies(n, words=150, changes=2, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.integers(0, words, changes):
            w[i] = f"x{rng.integers(0, 10**9)}"
        out.append(" ".join(w))
    return [" ".join(base), *out]


@pytest.mark.parametrize("heavy", [4, 256])
def test_deduplicate(spark, heavy, monkeypatch):
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, distance, radii, width, _, verifier: links(nodes, distance, radii, width, heavy, verifier))
    rng = np.random.default_rng(3)
    clean = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 40)) for _ in range(100)]
    texts = clean + near_copies(30) + [clean[5], None, ""]
    rows = [(i, t, "f", "n") for i, t in enumerate(texts)] + [(0, clean[0], "f", "n")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "node"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(101), 132]
    assert simhash.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def pairs_of_similarity(similarity, n, words, seed):
    """Texts whose sets of word 5-grams have about that Jaccard similarity: an end of each second text is new."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = [f"w{x}" for x in rng.integers(0, 10**6, words)]
        shingles = words - 4
        new = int(shingles * (1 - similarity) / (1 + similarity))
        out += [" ".join(a), " ".join([*a[: words - new], *(f"n{x}" for x in rng.integers(0, 10**6, new))])]
    return out


def jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.9), (0.85, 0.97), (0.9, 0.99), (0.77, 0.0)])
def test_recall_of_near_copies(spark, similarity, least):
    texts = pairs_of_similarity(similarity, 200, 60, 1) + pairs_of_similarity(similarity, 200, 300, 2)
    near = [jaccard(texts[i], texts[i + 1]) >= 0.8 for i in range(0, len(texts), 2)]
    assert np.mean(near) == (similarity >= 0.8)
    rows = [(i, t, "f", "n") for i, t in enumerate(texts)]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(i in kept for i in range(0, len(texts), 2))
    gone = np.mean([i not in kept for i in range(1, len(texts), 2)])
    assert gone >= least if similarity >= 0.8 else gone == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "a b c d e f", 5, 6)], "doc_id long, text string, near_key int, _row_key int")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 5, 6)]


def test_look_up_plan_keeps_its_recall():
    """Wider segments for more fingerprints: of simulated pairs at the bound no more are missed than stated, and chance pairs stay few."""
    rng = np.random.default_rng(4)
    assert simhash.look_up_plan(10) == simhash.look_up_plan(2**20) == (512, 20, 16)
    for n in (2**21, 10**8, 10**10):
        bits, width, balls = simhash.look_up_plan(n)
        assert bits % 64 == 0 and bits // width >= balls and 2**width >= n
        differs = (rng.random((4000, balls, width)) < simhash.bit_change(0.8)).sum(axis=2)
        assert (differs.min(axis=1) > 1).mean() < 0.05


def test_wide_plan_finds_what_the_usual_one_finds(spark):
    """The plan of a large corpus, applied to a small one."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(30):
        words = [f"w{i}" for i in rng.integers(0, 5000, 120)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join([*words[:118], "x", f"y{g}"])), (10 * g + 2, " ".join(f"w{i}" for i in rng.integers(0, 5000, 120)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits, width, balls = simhash.look_up_plan(2**24)
    kept = lambda df: sorted(r.doc_id for r in df.collect())
    assert kept(simhash.deduplicate(docs, bits=bits, width=width, balls=balls)) == kept(simhash.deduplicate(docs)) == [i for i, _ in rows if i % 10 != 1]
