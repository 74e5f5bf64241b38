"""Posting tables and the look-ups over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsync.functions.ids import big_endian, content_element, fingerprint_v4, other_ids
from recordsync.functions.text import word_set
from recordsync.operators.order import numbered
from recordsync.operators.records import packet_digest
from recordsync.sources.shared import stored


def metadata(records: DataFrame, text: str = "text") -> DataFrame:
    """``records`` with hash (MD5 of the text) and words: what every index is made from."""
    return records.withColumn("hash", content_element(F.col(text))).withColumn("words", word_set(F.col(text)))


def packet_id(body: Column) -> Column:
    """Fingerprint of a version 4 key or subkey body; its last 16 or 8 digits are the ids."""
    return fingerprint_v4(body)


def packet_metadata(records: DataFrame) -> DataFrame:
    """``records`` (packets) with hash, words of the user ids, id and sub_ids (eight digits, version 4) and ctime: what every index is made from."""
    short = lambda p: F.right(packet_id(p["body"]), F.lit(8))
    named = F.transform(F.filter("packets", lambda p: p["tag"] == 13), lambda p: F.decode(p["body"], "UTF-8"))
    key = F.get("packets", F.lit(0))
    rows = records.withColumn("hash", packet_digest(F.col("packets"))).withColumn("words", word_set(F.array_join(named, " ")))
    rows = rows.withColumn("id", short(key)).withColumn("sub_ids", other_ids(F.col("id"), F.transform(F.filter("packets", lambda p: p["tag"] == 14), short)))
    return rows.withColumn("ctime", F.timestamp_seconds(big_endian(F.substring(key["body"], 2, 4))))


def postings(table: DataFrame, item: Column, name: str, key: str = "hash", only: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """Distinct pairs ``(name, key)`` of the items of an array column, or those among ``only``, and the record's key.

    unique: no key repeats and the arrays are sets, so pairs are distinct as they come and none is shuffled.
    """
    if only is not None:
        item = F.array_intersect(item, F.array(*map(F.lit, only)).cast("array<string>"))
    pairs = table.select(F.explode(item).alias(name), key)
    return pairs if unique else pairs.distinct()


def build(table: DataFrame, first_by: Sequence[str], key: str = "hash", words: str = "words") -> dict[str, DataFrame]:
    """Index tables from one metadata table: records (of repeated keys the first by ``first_by``) and word postings."""
    order = F.struct(*first_by)
    rest = [c for c in table.columns if c not in (key, *first_by)]
    records = table.groupBy(key).agg(F.min_by(F.struct(*first_by, *rest), order).alias("r")).select(key, "r.*")
    return {"records": records, "words": postings(table, F.col(words), "word", key)}


def short_keys(records: DataFrame, key: str = "hash") -> Column:
    """What names the digests ``key`` of ``records`` in eight bytes: their first fifteen hex digits, a number; the digests themselves where two of them share these."""
    short = F.conv(F.left(key, F.lit(15)), 16, 10).cast("long")
    shared = records.select(key, short.alias("_k")).groupBy("_k").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).where("_a <> _b")
    return short if shared.isEmpty() else F.col(key)


def write_index(index: dict[str, DataFrame], folder: str, partitions: int | None = None, distinct: Sequence[str] = ()) -> None:
    """Write each index table sorted by its columns, so that point look-ups of the first one read few row groups.

    partitions: as many as shuffles have, fewer if rows are few, if not given. Ranges are of all columns, so a frequent item lies in several. Rows of the tables named
    in ``distinct`` may repeat and are written once: equal rows meet in the one shuffle that sorts them.
    """
    for name, df in index.items():
        cols = df.columns
        placed = df.repartitionByRange(*cols) if partitions is None else df.repartitionByRange(partitions, *cols)
        if name in distinct:
            # Their sort is the one below: no table of a task's rows is kept.
            each = Window.partitionBy(*cols).orderBy(cols[0])
            placed = placed.withColumn("_no", F.row_number().over(each)).where("_no = 1").drop("_no")
        placed.sortWithinPartitions(*cols).write.mode("overwrite").parquet(f"{folder}/{name}")


def document_frequency(words: DataFrame, item: str = "word") -> DataFrame:
    """Posting-list length of each item."""
    return words.groupBy(item).agg(F.count("*").alias("n"))


def match_all(words: DataFrame, wanted: Sequence[str], key: str = "hash") -> DataFrame:
    """Keys of the records that hold all of the ``wanted`` words, a set; none for no words."""
    asked = sorted(set(wanted))
    hits = words.where(F.col("word").isin(asked)).distinct()
    return hits.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(asked)).select(key) if asked else words.select(key).where("false")


def search(words: DataFrame, records: DataFrame, wanted: Sequence[str], key: str = "hash") -> DataFrame:
    """The records that hold all of the ``wanted`` words; unknown words give none."""
    return records.join(match_all(words, wanted, key), key, "left_semi")


def search_status(words: DataFrame, wanted: Sequence[str], rare_cap: int = 20_000, cap: int = 500, key: str = "hash") -> DataFrame:
    """One row ``(rarest, matches, status)``: whether a search may answer.

    ``not specific enough`` where the rarest word stands in more than ``rare_cap`` records, ``too many`` from
    ``cap`` matches on, else ``ok``. No word, or one that no record holds, makes rarest 0.
    """
    asked = sorted(set(wanted))
    n = document_frequency(words.where(F.col("word").isin(asked)).distinct())
    rarest = n.agg(F.when(F.count("*") == len(asked), F.coalesce(F.min("n"), F.lit(0))).otherwise(0).cast("long").alias("rarest"))
    # One row each: no join keys are needed.
    matches = match_all(words, asked, key).agg(F.count("*").alias("matches"))
    both = rarest.join(F.broadcast(matches))
    status = F.when(F.col("rarest") > rare_cap, "not specific enough").when(F.col("matches") >= cap, "too many").otherwise("ok")
    return both.select("rarest", "matches", status.alias("status"))


def search_many(words: DataFrame, searches: DataFrame, rare_cap: int = 20_000, cap: int = 500, key: str = "hash", beyond: bool = False) -> tuple[DataFrame, DataFrame]:
    """Many searches in one plan: ``(search, rarest, matches, status)`` of each of ``searches`` (search, words), and ``(search, key)`` of what those with status ok find.

    Postings are read once, for the words asked for. A search starts from the records of its rarest word; of these the ones stay that hold all others.
    Searches whose rarest word stands in more than ``rare_cap`` records go no further, and have null matches, but with ``beyond``. See
    :func:`search_status` for the statuses; searches are told apart by search, of equal ones the words count together.
    """
    asked = stored(searches.select("search", F.explode("words").alias("word")).distinct(), "asked")
    held = stored(words.select("word", key).join(asked.select("word").distinct(), "word", "left_semi").distinct(), "held")
    sized = asked.join(document_frequency(held), "word", "left").select("search", "word", F.coalesce("n", F.lit(0)).alias("n"))
    each = Window.partitionBy("search")
    ranked = sized.withColumn("place", F.row_number().over(each.orderBy("n", "word"))).withColumn("rarest", F.min("n").over(each)).withColumn("k", F.count("*").over(each))
    ranked = stored(ranked, "ranked")
    go = ranked.where("rarest > 0") if beyond else ranked.where(F.col("rarest").between(1, rare_cap))
    start = go.where("place = 1").join(held, "word").select("search", key, "k")
    rest = go.where("place > 1").select("search", "word")
    # What is left of a search holds its other words, one row for each.
    others = start.where("k > 1").join(rest, "search").join(held, ["word", key], "left_semi").groupBy("search", key, "k").agg(F.count("*").alias("n")).where("n = k - 1")
    hits = stored(start.where("k = 1").select("search", key).unionByName(others.select("search", key)), "hits")
    n = hits.groupBy("search").agg(F.count("*").alias("matches"))
    named = searches.select("search").distinct().join(ranked.where("place = 1").select("search", "rarest"), "search", "left").join(n, "search", "left")
    rarest, wide = F.coalesce("rarest", F.lit(0)), F.col("rarest") > rare_cap
    matches = F.coalesce("matches", F.lit(0)) if beyond else F.when(wide, F.lit(None)).otherwise(F.coalesce("matches", F.lit(0)))
    state = F.when(wide, "not specific enough").when(F.col("matches") >= cap, "too many").otherwise("ok")
    status = named.select("search", rarest.cast("long").alias("rarest"), matches.cast("long").alias("matches"), state.alias("status"))
    return status, hits.join(status.where("status = 'ok'").select("search"), "search", "left_semi")


def write_buckets(rows: DataFrame, name: str, key: str, folder: str, buckets: int = 200) -> DataFrame:
    """Write ``rows`` as a table ``name`` in ``folder``, in ``buckets`` by ``key`` and sorted within them, with Bloom filters of the key in its files.

    Joins on the key then leave this table where it lies: only what is asked is shuffled, or sent to all where it is small. Point filters read the row
    groups that may hold the value.
    """
    out = rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    out = out.option(f"parquet.bloom.filter.enabled#{key}", "true").option("path", folder).mode("overwrite")
    out.saveAsTable(name)
    return rows.sparkSession.table(name)


def guarded_search(words: DataFrame, records: DataFrame, wanted: Sequence[str], rare_cap: int = 20_000, cap: int = 500, key: str = "hash") -> DataFrame:
    """The matching records, each with ``status`` ok; where :func:`search_status` says otherwise, or nothing matches, one row of nulls with the status."""
    status = search_status(words, wanted, rare_cap, cap, key).select("status")
    rows = search(words, records, wanted, key).withColumn("_status", F.lit("ok"))
    return status.join(rows, F.col("status") == F.col("_status"), "left").drop("_status")


def multi_get(records: DataFrame, request: DataFrame, key: str = "hash") -> DataFrame:
    """Records of the requested keys; absent keys and repeats of a request are passed over."""
    return records.join(request.select(key).distinct(), key, "left_semi")


def absent(records: DataFrame, request: DataFrame, key: str = "hash") -> DataFrame:
    """Requested keys that no record has."""
    return request.select(key).distinct().join(records, key, "left_anti")


def id_postings(records: DataFrame, main: str, subs: str | None = None, key: str = "hash") -> DataFrame:
    """Pairs (id, key) by main id or, with ``subs``, by each sub-id that is not the main one."""
    if subs is None:
        return records.select(F.col(main).alias("id"), key).distinct()
    return records.select(F.explode(other_ids(F.col(main), F.col(subs))).alias("id"), key).distinct()


def by_id(main: DataFrame, records: DataFrame, ids: DataFrame, subs: DataFrame | None = None, key: str = "hash") -> DataFrame:
    """``(id, records' columns)`` of the wanted ``ids``, among main ids and, where given, sub-ids.

    Postings without a record are passed over. A record's own id is no sub-id, so no pair comes twice.
    """
    found = main if subs is None else main.unionByName(subs)
    return found.join(ids.select("id").distinct(), "id").join(records, key)


def refine(found: DataFrame, wanted: Column, main: str, subs: str) -> DataFrame:
    """After a look-up by short id: only rows whose whole main id, or one of the sub-ids, is the wanted one."""
    return found.where((F.col(main) == wanted) | F.array_contains(F.col(subs), wanted))


def refine_text(found: DataFrame, wanted: str, main: str, subs: str) -> DataFrame:
    """After a look-up by short id: rows whose fingerprint ``main``, or one of ``subs``, ends in ``wanted``, an id of 8 or 16 hex digits or a fingerprint of 40.

    Fingerprints of 32 digits, those of version 3, are refused, as are texts of other lengths.
    """
    if len(wanted) not in (8, 16, 40):
        raise ValueError("128-bit fingerprints are not supported" if len(wanted) == 32 else f"no id: {wanted}")
    n = F.lit(len(wanted))
    return found.where((F.right(main, n) == wanted) | F.exists(subs, lambda s: F.right(s, n) == wanted))


def refine_many(records: DataFrame, wanted: DataFrame, main: str, subs: str) -> DataFrame:
    """``records`` with each of the ids ``wanted`` (8, 16 or 40 hex digits) that ends their fingerprint or one of ``subs``: ids of other lengths find nothing.

    Records are found by the last eight digits, in one join for all ids; the whole id decides.
    """
    short = lambda c: F.right(c, F.lit(8))
    asked = wanted.select("wanted").where(F.length("wanted").isin(8, 16, 40)).distinct().withColumn("_short", short("wanted"))
    every = records.withColumn("_fp", F.explode(F.array_distinct(F.concat(F.array(main), F.coalesce(subs, F.array().cast("array<string>"))))))
    hits = every.withColumn("_short", short("_fp")).join(asked, "_short").where(F.endswith("_fp", "wanted"))
    return hits.drop("_fp", "_short").distinct()


def unique_name(records: DataFrame, id_col: str, name: str) -> DataFrame:
    """``(id, name)`` of ids that exactly one record has."""
    one = records.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("_n"), F.first(name).alias(name))
    return one.where("_n = 1").drop("_n")


def enrich(rows: DataFrame, issuer: str, records: DataFrame, id_col: str, name: str) -> DataFrame:
    """``rows`` with the name of the one record that ``issuer`` points to, null for none or several."""
    return rows.join(unique_name(records, id_col, name).withColumnRenamed("id", issuer), issuer, "left")


def audit_postings(words: DataFrame, records: DataFrame, items: str = "words", key: str = "hash") -> DataFrame:
    """``(word, key, problem)``: pairs that should be there but are ``missing``, and ``dangling`` ones that should not."""
    # The number and the combined hash of a key's words on either side tell which keys differ: a row for each, not for each pair.
    mixed = F.aggregate(F.array_distinct(items), F.lit(0).cast("long"), lambda x, w: x.bitwiseXOR(F.xxhash64(w)))
    size = F.size(F.array_distinct(items))
    own = records.where(F.size(items) > 0).groupBy(key).agg(F.min(F.struct(size, mixed)).alias("_a"), F.max(F.struct(size, mixed)).alias("_b"))
    held = words.groupBy(key).agg(F.struct(F.count("*").cast("int"), F.bit_xor(F.xxhash64("word"))).alias("_h"))
    keys = stored(own.join(held, key, "full_outer").where("not (_a <=> _b and _a <=> _h)").select(key), "keys")
    right = records.join(keys, key, "left_semi").select(F.explode(items).alias("word"), key, F.lit(1).alias("_side"))
    left = words.select("word", key).join(keys, key, "left_semi")
    both = right.unionByName(left.select("word", key, F.lit(2).alias("_side"))).groupBy("word", key).agg(F.min("_side").alias("_a"), F.max("_side").alias("_b"))
    return both.where("_a = _b").select("word", key, F.when(F.col("_a") == 1, "missing").otherwise("dangling").alias("problem"))


def back_fill(records: DataFrame, existing: DataFrame, items: Column, name: str, key: str = "hash") -> DataFrame:
    """Pairs to add to an index so that it holds all of ``records``."""
    return postings(records, items, name, key).join(existing, [name, key], "left_anti")


def newest_first(rows: DataFrame, time: str, *ties: str) -> DataFrame:
    """Rows that have a time, newest first."""
    return rows.where(F.col(time).isNotNull()).orderBy(F.desc(time), *ties)


def limited(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows (all for -1), each with the number of all rows as ``total``."""
    total = rows.agg(F.count("*").alias("total"))
    ordered = rows.orderBy(*order)
    return (ordered if n < 0 else ordered.limit(n)).join(F.broadcast(total))


def _drawn(rows: DataFrame, seed: int) -> list[Column]:
    told = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), *told)), *map(F.col, rows.columns)]


def random_rows(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn uniformly without repeats: those of the least MD5 of ``seed`` and the row, however the rows are dealt."""
    return rows.orderBy(*_drawn(rows, seed)).limit(n)


def random_drop(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``rows``, which are distinct, without ``n`` drawn at random."""
    return rows.join(random_rows(rows, n, seed), rows.columns, "left_anti")


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row by ``order`` of each key, all columns."""
    rest = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.min_by(rest, F.struct(*order)).alias("_r")).select(*key, "_r.*").select(rows.columns)


def bundles(rows: DataFrame, order: str, *ties: str, size: int = 100) -> DataFrame:
    """``rows`` with the number of the bundle of ``size`` that each falls in, by ascending ``order``, a number."""
    return numbered(rows, order, *ties, name="_no").withColumn("bundle", F.floor((F.col("_no") - 1) / size)).drop("_no")
