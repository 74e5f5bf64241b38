"""Texts, pages and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordsync.functions import ids, text
from recordsync.operators import reconcile, sinks
from recordsync.plans.registry import query
from recordsync.plans.tables import table
from recordsync.sources.text import nav_links, page_rows


@query("html_quote", """select page_id, md5(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;')) as quoted from pages""")
def html_quote(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.html_quote(F.col("html"))).alias("quoted"))


@query(
    "url_options",
    r"""with q as (select page_id, string_split(regexp_extract(url, '\?([^#]*)', 1), '&') as parts from pages),
    kv as (select page_id, split_part(p, '=', 1) as name, url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' ')) as value, i
        from q, unnest(parts) with ordinality as t(p, i) where contains(p, '='))
    select page_id, name, arg_max(value, i) as value from kv group by all""",
)
def url_options(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(text.url_options(F.col("url"))).alias("name", "value"))


@query("url_decode", "select page_id, url_decode(replace(url, '/', '%2F')) as url from pages")
def url_decode(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.url_decode(F.replace(F.col("url"), F.lit("/"), F.lit("%2F"))).alias("url"))


@query("url_encode", """select page_id, replace(replace(replace(replace(replace(replace(replace(url || ' "+', '+', '%2B'), '=', '%3D'), '&', '%26'), '"', '%22'), chr(13), '%0D'), chr(10), '%0A'), ' ', '+') as url from pages""")
def url_encode(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.url_encode(F.concat("url", F.lit(' "+'))).alias("url"))


@query(
    "url_pieces",
    """select page_id, trim(url, chr(9) || chr(10) || chr(13) || ' ') as stripped, split_part(url, '#', 1) as plain,
        case when contains(url, '?') then split_part(url, '?', 1) else url end as before, case when contains(url, '?') then substr(url, strpos(url, '?') + 1) end as after,
        len([x for x in string_split(url, '/') if x <> ''])::int as n_parts, starts_with(url, 'http://th') as starts from pages""",
)
def url_pieces(spark, sf):
    url = F.col("url")
    parts = text.split_list(F.replace(url, F.lit("/"), F.lit(",")))
    once = text.split_once(url, "?")
    return table(spark, sf, "pages").select(
        "page_id", text.strip(F.concat(F.lit(" \t"), url, F.lit("\n"))).alias("stripped"), text.decomment(url).alias("plain"),
        once["before"].alias("before"), once["after"].alias("after"), F.size(parts).alias("n_parts"), url.startswith("http://th").alias("starts"),
    )


@query(
    "nav_links",
    """with n as (select page_id, split_part(split_part(html, '<nav>', 2), '</nav>', 1) as nav from pages where contains(html, '<nav>')),
    a as (select page_id, unnest(regexp_extract_all(nav, '<a href="([^"]*)">[^<]*</a>')) as a, generate_subscripts(regexp_extract_all(nav, '<a href="([^"]*)">[^<]*</a>'), 1) - 1 as pos from n)
    select page_id, pos::int as pos, regexp_extract(a, 'href="([^"]*)"', 1) as target, regexp_extract(a, '>([^<]*)<', 1) as label from a""",
)
def nav_links_query(spark, sf):
    return nav_links(table(spark, sf, "pages"), "page_id", F.col("html"))


@query(
    "peer_table",
    """select page_id, p::int as pos, split_part(split_part(url, '/', 3), '.', 1) || p as host, (11370 + p)::int as port from pages, range(0, 3) as t(p) where p < page_id % 4""",
)
def peer_table(spark, sf):
    """Peers of a status page made of each page's host; a row after a foreign line does not count."""
    host = F.substring_index(F.element_at(F.split("url", "/"), 3), ".", 1)
    rows = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda p: F.concat(F.lit("<tr><td>"), host, p.cast("string"), F.lit(" "), (p + 11370).cast("string"), F.lit("</td></tr>")))
    kept = F.slice(rows, F.lit(1), (F.col("page_id") % 4).cast("int"))
    page = F.array_join(F.concat(F.array(F.lit("<p>\n<h2>Gossip Peers</h2>"), F.lit("<table>")), kept, F.array(F.lit("</table>"), F.lit("<tr><td>late 1</td></tr>"))), "\n")
    pages = table(spark, sf, "pages").select("page_id", page.alias("html"))
    return page_rows(pages, "page_id", F.col("html"), "<h2>Gossip Peers")


@query(
    "escape_fields",
    r"""select doc_id, md5(coalesce(array_to_string(list_transform(regexp_extract_all(text, '(?s)[\x00-\x7F]+|[^\x00-\x7F]'), lambda c:
        case when ascii(c) < 128 then replace(replace(c, '%', '%%'), ':', '%3A') else regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') end), ''), text)) as escaped from documents""",
)
def escape_fields(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(text.escape_field(F.col("text"))).alias("escaped"))


@query(
    "fp_pretty",
    r"""select doc_id, regexp_replace(f[1:20], '(.{4})', '\1 ', 'g') || ' ' || rtrim(regexp_replace(f[21:40], '(.{4})', '\1 ', 'g')) as pretty, right(f, 8) as short
    from (select doc_id, upper(sha1(text)) as f from documents)""",
)
def fp_pretty(spark, sf):
    digits = F.upper(F.sha1("text"))
    return table(spark, sf, "documents").select("doc_id", ids.pretty_fingerprint(digits).alias("pretty"), ids.short_id(digits).alias("short"))


@query("hex_round_trip", "select doc_id, hex(encode(lang)) as digits, lang as back, null::varchar as bad, length(hex(encode(lang)))::int as n from documents")
def hex_round_trip(spark, sf):
    digits = ids.hexify(F.encode("lang", "UTF-8"))
    bad = F.decode(ids.dehexify(F.concat(digits, F.lit("0"))), "UTF-8")
    return table(spark, sf, "documents").select("doc_id", digits.alias("digits"), F.decode(ids.dehexify(digits), "UTF-8").alias("back"), bad.alias("bad"), F.length(digits).alias("n"))


@query("byte_numbers", "select doc_id, ('0x' || md5(text)[1:6])::bigint as number, upper(lpad(to_hex(('0x' || md5(text)[1:6])::bigint), 8, '0')) as bytes, upper(md5(text)[1:6]) || '0000' as padded from documents")
def byte_numbers(spark, sf):
    three = F.unhex(F.substring(F.md5("text"), 1, 6))
    number = ids.big_endian(three)
    return table(spark, sf, "documents").select("doc_id", number.alias("number"), F.hex(ids.to_big_endian(number, 4)).alias("bytes"), F.hex(ids.fit_bytes(three, 5)).alias("padded"))


@query("long_ids", "select p_partkey, upper(right(md5(p_partkey::varchar), 16)) as id, upper(right(md5(p_partkey::varchar), 8)) as short from part")
def long_ids(spark, sf):
    """Ids of sixteen digits, with and without 0x, and their short forms."""
    digits = F.right(F.md5(F.col("p_partkey").cast("string")), F.lit(16))
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("0X"), digits)).otherwise(digits)
    return table(spark, sf, "part").select("p_partkey", ids.parse_id(said).alias("id"), ids.short_id(ids.parse_id(said)).alias("short"))


@query("parsed_ids", "select p_partkey, upper(right(md5(p_partkey::varchar), 8)) as id, null::varchar as bad from part")
def parsed_ids(spark, sf):
    digits = F.right(F.md5(F.col("p_partkey").cast("string")), F.lit(8))
    return table(spark, sf, "part").select("p_partkey", ids.parse_id(F.concat(F.lit("0x"), digits)).alias("id"), ids.parse_id(F.concat(digits, F.lit("1"))).alias("bad"))


@query("shard_plan", "select hash, doc_id, ((row_number() over (order by hash, doc_id) - 1) // 150)::bigint as shard from (select upper(md5(text)) as hash, doc_id from documents)")
def shard_plan(spark, sf):
    return sinks.shard_plan(table(spark, sf, "documents").select(ids.content_element(F.col("text")).alias("hash"), "doc_id"), 150)


@query(
    "dump_manifest",
    """with d as (select (row_number() over (order by upper(md5(text)), doc_id) - 1) // 150 as shard from documents)
    select count(distinct shard) as n_shards, count(*) as n_records, count(distinct shard) as n_files, true as timed from d""",
)
def dump_manifest(spark, sf):
    """Totals of a dump in shards of 150 documents, written and looked at again."""
    from recordsync.sources.shared import shared_folder

    folder = shared_folder(spark, "dump")
    sinks.dump_shards(table(spark, sf, "documents").select(ids.content_element(F.col("text")).alias("hash"), "doc_id"), folder, 150)
    return sinks.manifest_totals(spark, folder).select("n_shards", "n_records", "n_files", (F.col("started") <= F.col("ended")).alias("timed"))


_PEERS = """p as (select distinct 'a' as peer, upper(md5(text)) as hash from documents where doc_id % 7 = 0 union select distinct 'b', upper(md5(text)) from documents where doc_id % 11 = 0)"""


@query("diff_log_files", f"with {_PEERS} select peer, count(*) * 33 as bytes, md5(string_agg(hash || chr(10), '' order by hash)) as md5 from p group by peer")
def diff_log_files(spark, sf):
    """Differences from two peers written as sorted lines, a folder for each, and the size and MD5 of all that a folder's files hold, in order."""
    from recordsync.sources.shared import shared_folder

    docs = table(spark, sf, "documents").select("doc_id", ids.content_element(F.col("text")).alias("hash"))
    rows = docs.where("doc_id % 7 = 0").select(F.lit("a").alias("peer"), "hash").unionByName(docs.where("doc_id % 11 = 0").select(F.lit("b").alias("peer"), "hash"))
    folder = shared_folder(spark, "diff")
    sinks.diff_log(rows.distinct(), folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.regexp_extract("path", "peer=([^/]*)/", 1).alias("peer"), F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "text"))), lambda f: f["text"]), "")
    return named.groupBy("peer").agg(F.length(whole).cast("long").alias("bytes"), F.md5(whole).alias("md5"))


@query("text_manifest", """with d as (select hash, (row_number() over (order by hash) - 1) // 150 as shard from (select distinct upper(md5(text)) as hash from documents))
    select shard::bigint as shard, count(*) * 33 as bytes, md5(string_agg(hash || chr(10), '' order by hash)) as md5 from d group by shard""")
def text_manifest(spark, sf):
    """Hashes dumped as text in shards of 150, and the manifest with the MD5 of each file."""
    from recordsync.sources.shared import shared_folder

    folder = shared_folder(spark, "dump")
    sinks.dump_shards(table(spark, sf, "documents").select(ids.content_element(F.col("text")).alias("hash")).distinct(), folder, 150, kind="text")
    return sinks.manifest(spark, folder, "*.txt").select(F.regexp_extract("path", "shard=(\\d+)", 1).cast("long").alias("shard"), "bytes", "md5")


@query("diff_log_lines", """with a as (select distinct upper(md5(text)) as hash from documents where doc_id % 7 <> 0), b as (select distinct upper(md5(text)) as hash from documents where doc_id % 11 <> 0)
    select hash as line from b where hash not in (select hash from a)""")
def diff_log_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", ids.content_element(F.col("text")).alias("hash"))
    return reconcile.difference(docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 11 <> 0")).where("side = 'there'").select(F.col("hash").alias("line"))
