"""Queries of the training-data operators over the shared tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordsync.llm import align, blocks, chat, decontam, licenses, linededup, lm, media, negatives, onebit, packing, quality, simhash, toxicity
from recordsync.llm._common import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of every document from the chain fitted on its labelled ones."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.toxic_scores(docs.select("doc_id", "text"), docs, labels).drop("text")
    return scored.withColumn("toxic", F.coalesce(F.col("p_toxic") >= 0.5, F.lit(False)))


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a third of the ids is held out of learning."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    ranked = quality.rank(docs, quality.fit(docs, labels.where(~held)))
    return ranked.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them repeat earlier ones, and a digest of what stays."""
    out = linededup.deduplicate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document into which a benchmark item leaks, and that item."""
    found = decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "last_word")


@_query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of nine tenths of them; those without an id are not learned from."""
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    return lm.score(docs, lm.train(docs.where(~held))).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and wordings in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


@_query
def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every dialogue from the perspective of each participant."""
    out = chat.rotate(_table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    chars = F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"])
    return out.select("conv_id", "speaker", "n_turns", F.md5("text").alias("text_md5"), F.array_join(spans, ",").alias("mask"), chars.alias("n_masked"))


ORACLES["op5_chat_perspectives"] = r"""
with t as (
    select conv_id, turn, replace(replace(role, '<|', '<\|'), '|>', '|\>') as role, replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') as text
    from conversations where conv_id is not null
), numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text) as no from t
), seen as (
    select p.speaker, n.conv_id, n.no, n.text, n.role is not distinct from p.speaker as own,
        case when n.role is not distinct from p.speaker then '<|assistant|>' || chr(10)
            when n.role is null then '<|user|>' || chr(10) else '<|user name=' || n.role || '|>' || chr(10) end as head
    from numbered n join (select distinct conv_id, role as speaker from t) p using (conv_id)
), placed as (
    select *, length(head) + coalesce(sum(length(head) + length(text) + 8) over (
        partition by conv_id, speaker order by no rows between unbounded preceding and 1 preceding), 0) as start
    from seen
)
select conv_id, speaker, count(*) as n_turns,
    md5(string_agg(head || text || '<|end|>' || chr(10), '' order by no)) as text_md5,
    string_agg(start::bigint || '-' || (start + length(text))::bigint, ',' order by no) filter (own) as mask,
    cast(sum(length(text)) filter (own) as bigint) as n_masked
from placed group by conv_id, speaker
"""


@_query
def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of copies among the pictures drawn from all vectors, and edited copies of a tenth of them."""
    return media.copies(media.pictures(_table(spark, sf_dir, "embeddings")))


ORACLES["op3_line_dedup"] = r"""
with l as (
    select doc_id, i - 1 as line_no, raw,
        [w for w in string_split_regex(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\x0b\f\r]+') if w <> ''] as words
    from documents, unnest(string_split(text, chr(10))) with ordinality as t(raw, i)
), u as (
    select words, min({d: doc_id, n: line_no}) as place from l where len(words) >= 5 group by words
), v as (
    select place, 0 as pos, array_to_string(words, ' ') as variant from u where len(words) >= 10
    union all
    select place, p, array_to_string(list_concat(words[:p - 1], words[p + 1:]), ' ') from u, range(1, len(words) + 1) as r(p) where len(words) >= 10
), near as (
    select distinct b.place from v a join v b on a.variant = b.variant and a.place < b.place
    where a.pos = b.pos or a.pos = 0 or b.pos = 0
), kept as (
    select l.*, len(l.words) >= 5 and ({d: doc_id, n: line_no} <> u.place or u.place in (select place from near)) as gone
    from l left join u using (words)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    md5(coalesce(string_agg(raw, chr(10) order by line_no) filter (not gone), '')) as text_md5
from kept group by doc_id
"""


_TEMPLATES = ", ".join(
    f"({i}, '{label}', '{text}', {i < len(licenses.PHRASES)})" for i, (label, text) in enumerate([*licenses.PHRASES, *licenses.WORDINGS])
)
ORACLES["op7_license_scan"] = rf"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), t as (
    select template, label, string_split(text, ' ') as w, whole from (values {_TEMPLATES}) as v(template, label, text, whole)
), tg as (
    select template, label, whole, len(w) as size, i - 1 as off, array_to_string(w[i:i + 2], ' ') as gram from t, range(1, len(w) - 1) as r(i)
), dg as (
    select doc_id, i - 1 as pos, array_to_string(w[i:i + 2], ' ') as gram from d, range(1, len(w) - 1) as r(i)
), votes as (
    select doc_id, template, label, whole, size, pos - off as diagonal, list(distinct off) as offs, min(pos) as low, max(pos) + 2 as high
    from dg join tg using (gram) group by all
), steps as (
    select *, coalesce(whole or size < 10 or diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > 3, true)::int as fresh from votes
), grouped as (
    select *, sum(fresh) over (partition by doc_id, template order by diagonal) as grp from steps
), merged as (
    select doc_id, template, label, whole, size, grp, list_distinct(flatten(list(offs))) as offs, min(low) as low, max(high) as high, min(diagonal) as diagonal
    from grouped group by doc_id, template, label, whole, size, grp
), spans as (
    select *, len(list_distinct(flatten([[o, o + 1, o + 2] for o in offs]))) / size as part from merged
), counted as (
    select * from spans where case when whole or size < 10 then part = 1 else part >= 0.7 and high - low + 1 <= 1.5 * size + 3 end
), found as (
    select doc_id, count(*) filter (whole) as n_base, min(diagonal) filter (whole) as first_word, max(diagonal) filter (whole) as last_word,
        coalesce(array_to_string(list_sort(list(distinct label) filter (whole)), ','), '') as base_labels,
        array_to_string(list_sort(list(distinct label)), ',') as labels, max(part) as score
    from counted group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
    coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join found using (doc_id)
"""


@_query
def op12_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of the greatest inner product with each twentieth one."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return onebit.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


_VECTOR = "embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0"
ORACLES["op12_onebit_neighbours"] = f"""
with e as (
    select row_number() over () as no, vec_id, embedding::double[] as v from embeddings where {_VECTOR} and len([x for x in embedding if x <> 0]) > 0
), s as (
    select q.no as own, q.vec_id as query_id, e.no, e.vec_id, list_dot_product(q.v, e.v) as score from e q join e on q.no <> e.no and len(q.v) = len(e.v) where q.vec_id % 20 = 0
), r as (
    select *, row_number() over (partition by own order by score desc, vec_id nulls last, no) as rank from s
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each fiftieth vector; a seventh of the labels is moved on by one first."""
    rows = _table(spark, sf_dir, "embeddings").where(blocks.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return negatives.mine(rows.select("vec_id", label.alias("label"), whole.alias("v")), F.col("vec_id") % 50 == 0)


ORACLES["op13_hard_negatives"] = f"""
with e as (
    select row_number() over () as no, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v
    from embeddings where label is not null and {_VECTOR}
), s as (
    select a.no as anchor, a.vec_id as anchor_id, e.no, e.vec_id, a.label = e.label as same, list_dot_product(a.v, e.v)::bigint as score
    from e a join e on a.no <> e.no and len(a.v) = len(e.v) where a.vec_id % 50 = 0
), p as (
    select *, row_number() over (partition by anchor order by score desc, vec_id nulls last, no) as place from s where same qualify place <= 5
), n as (
    select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
        row_number() over (partition by p.anchor, p.no order by n.score desc, n.vec_id nulls last, n.no) as rank
    from p join s n on n.anchor = p.anchor and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score qualify rank <= 3
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n
"""


@_query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of the tokens of two vocabularies in every document, weighed by the documents of the pairs."""
    return align.scores(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
