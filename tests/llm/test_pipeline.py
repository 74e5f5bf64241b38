import corpus_pipeline
import pytest
from test_packing import check_places


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
            docs = corpus_pipeline.materialise(out)
            counts.append(docs.count())
    assert whole >= counts[0] >= counts[1] >= counts[2] >= counts[3] > whole / 2
    rows = corpus_pipeline.run(spark, sf).collect()
    check_places(rows, 2048)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_stages_over_no_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


LINE = "one line of seven words or so"
ODD = [
    (1, None), (2, ""), (3, "   "), (None, None), (None, "words of a text without an id here"), (4, f"{LINE}\nits own words stand here all alone"), (5, f"{LINE}\nother words stand here for this one"),
    (6, "twice the same row of words is here"), (6, "twice the same row of words is here"), (7, "word " * 60000), (8, "é ß \U0001f600 end"),
]
OWN = "doc_id long, text string, lang string, source string, n_chars long, p_toxic double, P_low_quality double, n_lines int, n_dropped int, near_key int, line_key int, line_gone int, leak int, _row_key int, _bad int"


@pytest.mark.parametrize("k", range(4))
def test_odd_rows_and_clashing_names(spark, sf, k):
    """Null, empty, very long and repeated texts pass each stage, and columns of the caller keep their values."""
    rows = [(i, t, "xx", "s", None if t is None else len(t), 0.9, 0.8, 3, 4, 5, 6, 7, 8, 9, 10) for i, t in ODD]
    docs = spark.createDataFrame(rows, OWN)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert all(tuple(r)[5:] == rows[0][5:] for r in out.collect())
    want = list(ODD)
    if name == "line_dedup":
        want[6] = (5, "other words stand here for this one")
    if name == "simhash_near_dedup":  # one of the texts without words and one of the repeated rows stay
        want = [x for x in want if x not in [(2, ""), (3, "   "), (None, None)]]
        want.remove(ODD[7])
    assert got == sorted(want, key=str)
