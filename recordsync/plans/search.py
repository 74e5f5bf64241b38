"""Posting tables and look-ups over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordsync.functions.ids import content_element
from recordsync.functions.text import word_set
from recordsync.operators import index
from recordsync.plans.registry import query
from recordsync.plans.tables import table

_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9À-ÿ]+'))"
_POSTINGS = f"select distinct upper(md5(text)) as hash, unnest({_WORDS}) as word from documents"


def _records(spark, sf):
    return index.metadata(table(spark, sf, "documents"))


def _postings(spark, sf, only=None):
    """Pairs of word and hash; repeated texts go first, in a shuffle of texts, so that no pair is shuffled."""
    docs = table(spark, sf, "documents").select(content_element(F.col("text")).alias("hash"), "text").dropDuplicates(["hash"])
    return index.postings(docs, word_set(F.col("text"), ordered=False), "word", only=only, unique=True)


@query(
    "word_search_all",
    f"""
    with p as ({_POSTINGS}), hit as (select hash from p where word in ('and', 'is', 'the', 'of') group by hash having count(*) = 4)
    select doc_id, upper(md5(text)) as hash, n_chars from documents where upper(md5(text)) in (select hash from hit)
    """,
)
def word_search_all(spark, sf):
    """Records that hold all of four words."""
    docs = table(spark, sf, "documents").withColumn("hash", content_element(F.col("text")))
    wanted = ["the", "and", "of", "is", "the"]
    return index.search(_postings(spark, sf, wanted), docs, wanted).select("doc_id", "hash", "n_chars")


@query("word_df", f"with p as ({_POSTINGS}) select word, count(*) as n from p group by word")
def word_df(spark, sf):
    return index.document_frequency(_postings(spark, sf))


@query("postings_build", f"{_POSTINGS}")
def postings_build(spark, sf):
    return _postings(spark, sf).select("hash", "word")


@query(
    "records_build",
    """
    select upper(md5(text)) as hash, min(doc_id) as doc_id, arg_min(lang, doc_id) as lang, arg_min(n_chars, doc_id) as n_chars
    from documents group by 1
    """,
)
def records_build(spark, sf):
    docs = _records(spark, sf).select("hash", "doc_id", "lang", "n_chars", "words")
    return index.build(docs, ["doc_id"])["records"].select("hash", "doc_id", "lang", "n_chars")


@query(
    "record_metadata",
    f"""select doc_id, upper(md5(text)) as hash, cast(len({_WORDS}) as bigint) as n_words,
        array_to_string(list_sort({_WORDS}), ' ') as words from documents""",
)
def record_metadata(spark, sf):
    docs = _records(spark, sf)
    return docs.select("doc_id", "hash", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


@query(
    "search_capped",
    f"""
    with p as ({_POSTINGS}), q as (select unnest([['the', 'and'], ['loser', 'the'], ['nosuchword', 'the'], ['scum', 'trash', 'idiot']]) as words, unnest([0, 1, 2, 3]) as no),
    n as (select no, w.word, (select count(*) from p where p.word = w.word) as n, len(words) as k from q, unnest(words) as w(word)),
    hits as (select no, hash from n join p using (word) group by no, hash, k having count(*) = k)
    select no, min(n)::bigint as rarest, (select count(*) from hits h where h.no = n.no) as matches,
        case when min(n) > 400 then 'not specific enough' when (select count(*) from hits h where h.no = n.no) >= 20 then 'too many' else 'ok' end as status
    from n group by no
    """,
)
def search_capped(spark, sf):
    """Status of four searches with caps of 400 and 20."""
    words = _postings(spark, sf, ["the", "and", "loser", "nosuchword", "scum", "trash", "idiot"])
    asked = spark.createDataFrame([(0, ["the", "and"]), (1, ["loser", "the"]), (2, ["nosuchword", "the"]), (3, ["scum", "trash", "idiot"])], "search int, words array<string>")
    return index.search_many(words, asked, 400, 20, beyond=True)[0].withColumnRenamed("search", "no")


_MANY = f"""p as ({_POSTINGS}), q as (select doc_id as search, unnest(list_sort({_WORDS})[1:3]) as word from documents where doc_id % 100 = 0),
    n as (select search, q.word, (select count(*) from p where p.word = q.word) as n, count(*) over (partition by search) as k from q),
    hits as (select search, hash from n join p using (word) group by search, hash, k having count(*) = k),
    m as (select search, count(*) as matches from hits group by search),
    s as (select search, min(n)::bigint as rarest, coalesce(any_value(matches), 0)::bigint as matches,
        case when min(n) > 20000 then 'not specific enough' when coalesce(any_value(matches), 0) >= 500 then 'too many' else 'ok' end as status from n left join m using (search) group by search)"""


def _many(spark, sf):
    """Searches for the first three words, in order, of all documents whose id is divisible by 100."""
    docs = table(spark, sf, "documents").where("doc_id % 100 = 0")
    return index.search_many(_postings(spark, sf), docs.select(F.col("doc_id").alias("search"), F.slice(word_set(F.col("text")), 1, 3).alias("words")))


@query("search_many", f"with {_MANY} select search, rarest, case when status <> 'not specific enough' then matches end as matches, status from s")
def search_many(spark, sf):
    """Status of many searches in one plan."""
    return _many(spark, sf)[0]


@query("search_many_hits", f"with {_MANY} select search, hash from hits where search in (select search from s where status = 'ok')")
def search_many_hits(spark, sf):
    """What many searches find, but for those that find too much."""
    return _many(spark, sf)[1]


@query(
    "search_guarded",
    f"""
    with p as ({_POSTINGS}), hit as (select hash from p where word in ('scum', 'the') group by hash having count(*) = 2)
    , s as (select case when least((select count(*) from p where word = 'scum'), (select count(*) from p where word = 'the')) > 20000 then 'not specific enough'
        when (select count(*) from hit) >= 500 then 'too many' else 'ok' end as status)
    select status, doc_id, h as hash from s left join (select doc_id, upper(md5(text)) as h from documents where upper(md5(text)) in (select hash from hit)) on status = 'ok'
    """,
)
def search_guarded(spark, sf):
    """The answer of a search, or the reason why there is none."""
    docs = table(spark, sf, "documents").withColumn("hash", content_element(F.col("text"))).select("doc_id", "hash")
    return index.guarded_search(_postings(spark, sf, ["scum", "the"]), docs, ["scum", "the"])


_REQUEST = "select distinct upper(md5(text)) as hash from documents where doc_id % 100 = 0 union all select upper(md5(doc_id::varchar)) from documents where doc_id % 100 = 0"


def _request(spark, sf):
    """The queries: hashes of the texts, and of the ids, of all documents whose id is divisible by 100."""
    docs = table(spark, sf, "documents")
    there = docs.where("doc_id % 100 = 0").select(content_element(F.col("text")).alias("hash"))
    return there.unionByName(docs.where("doc_id % 100 = 0").select(content_element(F.col("doc_id").cast("string")).alias("hash")))


@query("multi_get", f"select doc_id, upper(md5(text)) as hash from documents where upper(md5(text)) in ({_REQUEST})")
def multi_get(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", content_element(F.col("text")).alias("hash"))
    return index.multi_get(docs, _request(spark, sf)).select("doc_id", "hash")


@query("bucketed_get", f"select doc_id, upper(md5(text)) as hash from documents where upper(md5(text)) in ({_REQUEST})")
def bucketed_get(spark, sf):
    """Look-ups by hash in a table that was hashed, bucketed and sorted once."""
    from recordsync.sources.shared import shared_folder

    docs = table(spark, sf, "documents").select("doc_id", content_element(F.col("text")).alias("hash"))
    folder = shared_folder(spark, "bucketed")
    held = index.write_buckets(docs, folder.rpartition("/")[2].replace("-", "_"), "hash", folder, 16)
    return index.multi_get(held, _request(spark, sf)).select("doc_id", "hash")


@query("multi_get_absent", f"select distinct hash from ({_REQUEST}) where hash not in (select upper(md5(text)) from documents)")
def multi_get_absent(spark, sf):
    docs = table(spark, sf, "documents").select(content_element(F.col("text")).alias("hash"))
    return index.absent(docs, _request(spark, sf))


@query("hash_lookup", "select doc_id, lang, source from documents where md5(text) = (select md5(text) from documents where doc_id = 7)")
def hash_lookup(spark, sf):
    """Records with the content of document 7."""
    docs = table(spark, sf, "documents").withColumn("hash", content_element(F.col("text")))
    return index.multi_get(docs, docs.where("doc_id = 7").select("hash")).select("doc_id", "lang", "source")


def _orders(spark, sf):
    """Orders as records: the part of line 1 is the main id, all parts are sub-ids."""
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("hash")).agg(
        F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("main"), F.collect_list("l_partkey").alias("subs")
    )


_ORDERS = r"""
    o as (select l_orderkey as hash, min({a: l_linenumber, b: l_partkey}).b as main from lineitem group by 1),
    s as (select distinct l_orderkey as hash, l_partkey as id from lineitem join o on l_orderkey = hash where l_partkey <> main)
"""


@query("id_lookup", f"with {_ORDERS} select main as id, hash from o")
def id_lookup(spark, sf):
    orders = _orders(spark, sf)
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return index.by_id(index.id_postings(orders, "main"), orders, ids).select("id", "hash")


@query(
    "id_or_subid_lookup",
    f"with {_ORDERS} select main as id, hash from o union all select id, hash from s",
)
def id_or_subid_lookup(spark, sf):
    orders = _orders(spark, sf)
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return index.by_id(index.id_postings(orders, "main"), orders, ids, index.id_postings(orders, "main", "subs")).select("id", "hash")


@query(
    "id_refine",
    """
    with k as (select p_partkey, upper(md5(p_partkey::varchar)) as id from part)
    select p_partkey, id from k where right(id, 2) = 'A7' and id like '%0A7'
    """,
)
def id_refine(spark, sf):
    """Parts whose short id (two digits here) is A7, refined to those whose longer one (three) fits as well."""
    parts = table(spark, sf, "part").select("p_partkey", content_element(F.col("p_partkey").cast("string")).alias("id"))
    probed = parts.where(F.right("id", F.lit(2)) == "A7").withColumn("long", F.right("id", F.lit(3))).withColumn("subs", F.array(F.col("id")))
    return index.refine(probed, F.lit("0A7"), "long", "subs").select("p_partkey", "id")


@query(
    "signer_enrich",
    """
    with one as (select c_nationkey * 1000 + (c_custkey % 1000) as id, min(c_name) as signer from customer group by 1 having count(*) = 1)
    select o_orderkey, signer from orders left join one on id = (o_custkey % 25) * 1000 + (o_custkey % 1000)
    """,
)
def signer_enrich(spark, sf):
    """Orders with the name of the one customer of an issuer id; ids are such that none or several may have one."""
    customers = table(spark, sf, "customer").select((F.col("c_nationkey") * 1000 + F.col("c_custkey") % 1000).alias("id"), F.col("c_name").alias("signer"))
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 25 * 1000 + F.col("o_custkey") % 1000).alias("issuer"))
    return index.enrich(orders, "issuer", customers, "id", "signer").select("o_orderkey", "signer")


@query(
    "posting_audit",
    f"""
    with p as ({_POSTINGS}), held as (select * from p where not (word = 'the' and substr(hash, 1, 1) = 'A') union all select 'none', 'the'),
    docs as (select * from p where substr(hash, 1, 1) <> 'B')
    select word, hash, 'missing' as problem from (select word, hash from docs except select word, hash from held)
    union all select word, hash, 'dangling' from (select word, hash from held except select word, hash from docs)
    """,
)
def posting_audit(spark, sf):
    """Postings that lack a word of some records, against records of which some have gone."""
    records = _records(spark, sf)
    words = _postings(spark, sf).where("not (word = 'the' and substr(hash, 1, 1) = 'A')")
    words = words.unionByName(spark.range(1).select(F.lit("the").alias("word"), F.lit("none").alias("hash")))
    return index.audit_postings(words, records.where("substr(hash, 1, 1) <> 'B'")).select("word", "hash", "problem")


@query(
    "subid_back_fill",
    """
    select distinct l_partkey as id, l_orderkey as hash from lineitem
    except select l_partkey, l_orderkey from lineitem where l_suppkey % 3 = 0
    """,
)
def subid_back_fill(spark, sf):
    lines = table(spark, sf, "lineitem")
    held = lines.where("l_suppkey % 3 = 0").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("hash")).distinct()
    records = lines.groupBy(F.col("l_orderkey").alias("hash")).agg(F.collect_list("l_partkey").alias("subs"))
    return index.back_fill(records, held, F.col("subs"), "id")


@query("newest_first", "select o_orderkey, o_orderdate from orders where o_orderdate is not null order by o_orderdate desc, o_orderkey limit 500")
def newest_first(spark, sf):
    """The 500 newest orders, a top-k report."""
    return index.newest_first(table(spark, sf, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate").limit(500)


@query("limit_with_total", "select o_orderkey, o_totalprice, (select count(*) from orders) as total from orders order by o_totalprice desc, o_orderkey limit 10")
def limit_with_total(spark, sf):
    """The ten dearest orders and the number of all."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return index.limited(orders, 10, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("random_elements", "select doc_id from documents order by md5('4|' || doc_id), doc_id limit 500")
def random_elements(spark, sf):
    """Five hundred documents drawn at random, a sampling operator."""
    return index.random_rows(table(spark, sf, "documents").select("doc_id"), 500, seed=4)


@query("random_dropped", "select count(*) - 500 as n, count(*) filter (doc_id < 0) as strange from documents having count(*) > 500 union all select 0, 0 from documents having count(*) <= 500")
def random_dropped(spark, sf):
    """How many documents are left when five hundred drawn at random have gone."""
    ids = table(spark, sf, "documents").select("doc_id")
    left = index.random_drop(ids, 500, seed=4)
    return left.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") < 0).alias("strange"))


@query("index_written", f"with p as ({_POSTINGS}) select doc_id, upper(md5(text)) as hash from documents where upper(md5(text)) in (select hash from p where word in ('and', 'is', 'the', 'of') group by hash having count(*) = 4)")
def index_written(spark, sf):
    """A search over index tables that were written, sorted by word, and read back."""
    from recordsync.sources.shared import shared_folder

    docs = table(spark, sf, "documents").withColumn("hash", content_element(F.col("text")))
    docs = docs.withColumn("key", index.short_keys(docs))
    folder = shared_folder(spark, "index")
    # Copies of a text give the same pairs, which are told apart from others where they are sorted.
    pairs = index.postings(docs, word_set(F.col("text"), ordered=False), "word", "key", unique=True)
    index.write_index({"words": pairs, "ids": docs.select("key", "hash", "doc_id")}, folder, distinct=("words",))
    words, ids = (spark.read.parquet(f"{folder}/{name}") for name in ("words", "ids"))
    return index.search(words, ids, ["the", "and", "of", "is"], "key").select("doc_id", "hash")


@query("first_wins", "select md5(text) as k, min(doc_id) as doc_id, arg_min(source, doc_id) as source from documents group by 1")
def first_wins(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("k"), "doc_id", "source")
    return index.first_wins(docs, ["k"], ["doc_id"])


@query("bundles", "select doc_id, cast(floor((row_number() over (order by doc_id) - 1) / 100) as bigint) as bundle from documents")
def bundles(spark, sf):
    return index.bundles(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("record_count", "select count(*) as n from documents")
def record_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"))


@query("key_scan", "select upper(md5(text)) as hash, doc_id from documents")
def key_scan(spark, sf):
    """Keys and ids alone: the scan reads two columns."""
    return table(spark, sf, "documents").select(content_element(F.col("text")).alias("hash"), "doc_id")


@query(
    "word_set_bytes",
    r"""with c as (select doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)[\x00-\x7F]+|[^\x00-\x7F]'), lambda x: case when unicode(x) < 128 then lower(x)
        when unicode(x) < 2048 then chr((case when unicode(x) // 64 in (23, 31) then 192 else 224 end + unicode(x) // 64)::int) || ' '
        when unicode(x) < 65536 then chr((224 + unicode(x) // 4096)::int) || ' ' else chr((240 + unicode(x) // 262144)::int) || ' ' end), '') as t from documents),
    w as (select unnest(list_distinct(regexp_extract_all(t, '[a-z0-9À-ÿ]+'))) as word from c)
    select word, count(*) as n from w group by word""",
)
def word_set_bytes(spark, sf):
    """Words by bytes, as byte-oriented indexes cut them, with document counts."""
    docs = table(spark, sf, "documents")
    return docs.select(F.explode(word_set(F.col("text"), "latin1_bytes")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
