"""Records of parents and children: digests, canonical form, merging, ranking, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsync.functions.ids import to_big_endian

#: Order of packets: a key, its signatures, then user ids or attributes and subkeys with theirs.
GRAMMAR_V4 = "^PS*([UA]S*)*(KS*)*$"
GRAMMAR_V3 = "^PS*([UA]S*)*$"


def digest(children: DataFrame, record: str, item: Column) -> DataFrame:
    """``(record, hash)``: MD5, in upper-case hex, of a record's items in sorted order, repeats kept, each with its length before it."""
    framed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x))
    return children.groupBy(record).agg(F.upper(F.md5(F.array_join(framed, ""))).alias("hash"))


def packet_digest(packets: Column) -> Column:
    """MD5, in upper-case hex, of packets (tag, body) sorted by tag, then body: tag, length and body of each, numbers in four bytes."""
    order = F.array_sort(F.transform(packets, lambda p: F.struct(p["tag"].alias("tag"), p["body"].alias("body"))))
    parts = F.transform(order, lambda p: F.concat(F.hex(to_big_endian(p["tag"], 4)), F.hex(to_big_endian(F.octet_length(p["body"]), 4)), F.hex(p["body"])))
    return F.upper(F.md5(F.unhex(F.array_join(parts, ""))))


def well_formed(letters: Column, version: Column) -> Column:
    """Whether the packets of a record, one letter each, follow the grammar of its version."""
    return F.when(version >= 4, letters.rlike(GRAMMAR_V4)).otherwise(letters.rlike(GRAMMAR_V3))


def grammar(items: DataFrame, record: str, order: Sequence[str], letter: str = "letter", headed: bool = True) -> DataFrame:
    """``(record, v4, v3, n_after)``: what :func:`well_formed` says of each record, from rows of one letter each, and how many rows stand from the first breach (version 4) on.

    A record breaks the grammar where it does not begin with its key, has another key or a strange packet, or a user id or attribute after
    a subkey (version 3: any subkey). These are least places, so partial aggregates of a record combine in any order: no task holds a
    record, however long. Without ``headed`` the keys are left out of the rows.
    """
    at, kind = F.struct(*order), F.col(letter)
    ends = items.groupBy(record).agg(F.min(at).alias("_first"), F.min(F.when(kind == "K", at)).alias("_k"))
    inner = kind.isin("S", "U", "A", "K")
    fits = F.when(at == F.col("_first"), kind == "P").otherwise(inner) if headed else inner
    bad = ~F.coalesce(fits, F.lit(False)) | F.coalesce(kind.isin("U", "A") & (at > F.col("_k")), F.lit(False))
    first_bad = items.join(ends, record).groupBy(record).agg(F.min(F.when(bad, at)).alias("_bad"), F.max(F.col("_k").isNotNull()).alias("_has_k"))
    behind = items.join(first_bad.where("_bad is not null"), record).where(at >= F.col("_bad")).groupBy(record).agg(F.count("*").alias("n_after"))
    out = first_bad.join(behind, record, "left")
    whole = F.col("_bad").isNull()
    return out.select(record, whole.alias("v4"), (whole & ~F.col("_has_k")).alias("v3"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def canonical(children: DataFrame, record: str, parent: str, child: Column) -> DataFrame:
    """``(record, parent, children)``: children regrouped under equal parents, distinct and sorted."""
    return children.groupBy(record, parent).agg(F.array_sort(F.collect_set(child)).alias("children"))


def merge(children: DataFrame, identity: str, record: str, parent: str, child: Column) -> DataFrame:
    """``(identity, parent, children)`` of the identities that two or more records have: the union of their children."""
    several = children.groupBy(identity).agg(F.min(record).alias("_a"), F.max(record).alias("_b")).where("_a <> _b").select(identity)
    return canonical(children.join(several, identity, "left_semi"), identity, parent, child)


def merge_deletes(children: DataFrame, identity: str, record: str) -> DataFrame:
    """``(record)``: the records that a merge replaces."""
    several = children.groupBy(identity).agg(F.min(record).alias("_a"), F.max(record).alias("_b")).where("_a <> _b").select(identity)
    return children.join(several, identity, "left_semi").select(record).distinct()


def merge_candidates(incoming: DataFrame, stored: DataFrame, id_col: str, identity: str, key: str = "hash") -> DataFrame:
    """``(new, old)``: each incoming record that is not stored yet, with the stored ones of its id and identity."""
    new = incoming.join(stored, key, "left_anti").select(id_col, identity, F.col(key).alias("new"))
    return new.join(stored.select(id_col, identity, F.col(key).alias("old")), [id_col, identity]).where("new <> old").select("new", "old")


def apply_updates(base: DataFrame, deletes: DataFrame, adds: DataFrame, key: str) -> DataFrame:
    """``base`` after a batch: deletes first, then adds; an added key replaces a row of that key."""
    gone = deletes.select(key).unionByName(adds.select(key))
    return base.join(gone, key, "left_anti").unionByName(adds)


def update_log(deletes: DataFrame, adds: DataFrame, key: str) -> DataFrame:
    """``(key, op)`` of a batch, one row for each change."""
    return deletes.select(key, F.lit("Delete").alias("op")).unionByName(adds.select(key, F.lit("Add").alias("op")))


def only_new(records: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Records that a base snapshot does not hold."""
    return records.join(base, key, "left_anti")


def duplicate_groups(rows: DataFrame, key: Column) -> DataFrame:
    """``(key, n)`` of the keys that several rows have."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_members(rows: DataFrame, key: Column, value: str) -> DataFrame:
    """``(key, n, value)``: a row for each row of ``rows`` whose key several rows have."""
    return rows.select(key.alias("key"), value).join(duplicate_groups(rows, key), "key").select("key", "n", value)


def primary_first(rows: DataFrame, record: str, primary: Column, time: str, position: str) -> DataFrame:
    """``rows`` with their number within the record: primary ones first, the newest ahead, then the rest as they stood."""
    order = Window.partitionBy(record).orderBy(F.desc(primary), F.desc_nulls_last(F.when(primary, F.col(time))), position)
    return rows.withColumn("no", F.row_number().over(order))


def by_time(rows: DataFrame, record: str, time: str, position: str) -> DataFrame:
    """``rows`` with their number within the record by time, missing times first, else as they stood."""
    return rows.withColumn("no", F.row_number().over(Window.partitionBy(record).orderBy(F.asc_nulls_first(time), position)))


def latest(rows: DataFrame, record: str, time: str, value: str, position: str) -> DataFrame:
    """``(record, last, value)``: the greatest time and the value there; of equal times the first row's. Null times are lowest."""
    best = F.max_by(F.struct(F.col(time).alias("last"), F.col(value)), F.struct(F.col(time), -F.col(position)))
    return rows.groupBy(record).agg(best.alias("_b")).select(record, "_b.*")


def merged_packets(records: DataFrame) -> DataFrame:
    """``(identity, packets)``: the records (identity, packets) of each identity as one in canonical form.

    A signature belongs to the packet before it that is none. Equal parents are one, with the distinct signatures of all; the
    key comes first, then user ids and attributes, then subkeys, each by body. A record must begin with what is no signature.
    """
    # The last packet that is no signature, carried along each record in one pass.
    along = Window.partitionBy("_rec").orderBy("_pos")
    rows = records.select("identity", "packets", F.monotonically_increasing_id().alias("_rec")).select("identity", "_rec", F.posexplode("packets").alias("_pos", "p"))
    parent = F.last(F.when(F.col("p.tag") != 2, F.col("p")), ignorenulls=True).over(along)
    each = rows.select("identity", parent.alias("parent"), F.when(F.col("p.tag") == 2, F.col("p")).alias("child")).distinct()
    groups = each.groupBy("identity", "parent").agg(F.array_sort(F.collect_list("child")).alias("children"))
    rank = F.when(F.col("parent.tag") == 6, 0).when(F.col("parent.tag") == 14, 2).otherwise(1)
    row = F.struct(rank.alias("rank"), F.col("parent.tag").alias("tag"), F.col("parent.body").alias("body"), "parent", "children")
    whole = groups.groupBy("identity").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return whole.select("identity", F.flatten(F.transform("rows", lambda r: F.concat(F.array(r["parent"]), r["children"]))).alias("packets"))


def with_valid_children(parents: DataFrame, children: DataFrame, valid: Column, key: str) -> DataFrame:
    """Parents that have a valid child."""
    return parents.join(children.where(valid).select(key), key, "left_semi")


def revoked(children: DataFrame, record: str, types: Sequence, kind: str) -> DataFrame:
    """``(record, revoked)``: whether any child is of a revoking type."""
    return children.groupBy(record).agg(F.coalesce(F.bool_or(F.col(kind).isin(list(types))), F.lit(False)).alias("revoked"))


def self_signatures(signatures: DataFrame) -> DataFrame:
    """Certifications (types 0x10 to 0x13) by the record's own id that name just one issuer."""
    return signatures.where("sigtype between 16 and 19 and n_issuers = 1 and issuer = id")


def report_lines(info: DataFrame, uids: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """``(record, no, line)``: ``pub``, ``uid`` and ``uat`` lines.

    info: record, fields (array of texts); uids: record, pos, fields; attributes: record, pos. Line 0 of a record is its ``pub`` line.
    """
    pub = info.select("record", F.lit(0).cast("long").alias("no"), F.concat_ws(":", F.lit("pub"), F.array_join("fields", ":", "")).alias("line"))
    uid = uids.select("record", F.col("pos").cast("long").alias("no"), F.concat_ws(":", F.lit("uid"), F.array_join("fields", ":", "")).alias("line"))
    if attributes is None:
        return pub.unionByName(uid)
    return pub.unionByName(uid).unionByName(attributes.select("record", F.col("pos").cast("long").alias("no"), F.lit("uat::::").alias("line")))


def report_head(info: DataFrame) -> DataFrame:
    """The line before all others: ``info:1:`` and the number of records."""
    return info.agg(F.concat(F.lit("info:1:"), F.count("*").cast("string")).alias("line"))
