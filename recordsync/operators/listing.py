"""Presentation of records: what is shown of them, index listings and detailed listings of signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsync.functions.codes import algorithm_letter
from recordsync.functions.times import date_text, expiry, is_expired

#: Where a date is missing.
NO_DATE = "_" * 10
#: Names of more bytes are replaced by a note of their size.
LONG_NAME = 1024


def presented(keys: DataFrame, components: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is shown of records: the ``components`` and the ``signatures`` that are left.

    keys: record, good; components: record, component, kind (``self`` for signatures of the key itself, else ``uid`` or ``subkey``), good;
    signatures: record, component, good. A record goes if its key is bad. Bad signatures go, then components that are left
    without one, but for ``self``, and bad subkeys, each with its signatures.
    """
    shown = keys.where("good").select("record").distinct()
    sigs = signatures.where("good").join(shown, "record", "left_semi")
    signed = components.where("kind <> 'self' and (kind <> 'subkey' or good)").join(sigs, ["record", "component"], "left_semi")
    own = components.where("kind = 'self'").join(shown, "record", "left_semi")
    left = signed.unionByName(own)
    return left, sigs.join(left, ["record", "component"], "left_semi")


def shown_name(name: Column) -> Column:
    """A name, or where it is too long its size."""
    size = F.octet_length(name)
    return F.when(size > LONG_NAME, F.concat(F.lit("["), size.cast("string"), F.lit(" bytes]"))).otherwise(name)


def primary_order(record: str = "record") -> Window:
    """Primary user ids first, the newest ahead, the rest as they stand (columns is_primary, time, pos)."""
    return Window.partitionBy(record).orderBy(F.desc("is_primary"), F.desc_nulls_last(F.when(F.col("is_primary"), F.col("time"))), "pos")


def index_lines(keys: DataFrame, uids: DataFrame) -> DataFrame:
    """``(record, no, line)``: for each record a line ``bits letter / short id  date`` with a mark where revoked, then its user ids, primary ones first.

    keys: record, keylen, alg, id, ctime, revoked; uids: record, pos, uid, is_primary, time.
    """
    head = F.concat(
        F.lit("pub  "), F.lpad(F.col("keylen").cast("string"), 4, " "), algorithm_letter(F.col("alg")), F.lit("/"), F.right("id", F.lit(8)), F.lit(" "),
        F.coalesce(date_text(F.col("ctime")), F.lit(NO_DATE)), F.when(F.col("revoked"), " *** KEY REVOKED ***").otherwise(""),
    )
    lines = keys.select("record", F.lit(0).cast("long").alias("no"), head.alias("line"))
    named = uids.select("record", F.row_number().over(primary_order()).cast("long").alias("no"), shown_name(F.col("uid")).alias("line"))
    return lines.unionByName(named)


def signature_label(kind: Column, expired: Column) -> Column:
    """Short label of a signature's type: certifications by level, ``exp`` where expired, revocations, bindings, others by number."""
    level = F.when(kind == 0x10, "").otherwise((kind - 0x10).cast("string"))
    certification = F.concat(F.when(expired, "exp").otherwise("sig"), level)
    other = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(kind), 2, "0")))
    return (
        F.when(kind.between(0x10, 0x13), certification).when(kind.isin(0x20, 0x28, 0x30), "revok").when(kind == 0x1F, "dirct").when(kind == 0x18, "sbind").otherwise(other)
    )


def signature_lines(signatures: DataFrame, now: Column) -> DataFrame:
    """``(record, pos, no, line)``: a line for each signature, and one more each for its policy, notation and revoker.

    signatures: record, pos, sigtype, issuer, self_id, signer, signer_uid, ctime, exp_secs, key_ctime, key_exp_secs, policy_url, notation (name,
    value), revoker. A line has the label, the issuer's short id, the dates of the signature, its expiry and the key's, and who
    signed: the name in the signature, ``[selfsig]``, the signer's name, or ``[]``.
    """
    date = lambda c: F.coalesce(date_text(c), F.lit(NO_DATE))
    who = F.coalesce("signer_uid", F.when(F.col("issuer") == F.col("self_id"), "[selfsig]"), "signer", F.lit("[]"))
    first = F.concat_ws(
        " ", F.lit("sig"), F.rpad(signature_label(F.col("sigtype"), is_expired(F.col("ctime"), F.col("exp_secs"), now)), 6, " "), F.coalesce(F.right("issuer", F.lit(8)), F.lit("no keyid")),
        date(F.col("ctime")), date(expiry(F.col("ctime"), F.col("exp_secs"))), date(expiry(F.col("key_ctime"), F.col("key_exp_secs"))), shown_name(who),
    )
    more = F.array(
        first, F.concat(F.lit("    Policy URL: "), "policy_url"), F.concat(F.lit("    Notation data: "), "notation.name", F.lit(" "), "notation.value"),
        F.concat(F.lit("    Revocation key fingerprint: "), "revoker"),
    )
    each = signatures.select("record", "pos", F.posexplode(F.filter(more, lambda x: x.isNotNull())).alias("no", "line"))
    return each.select("record", "pos", F.col("no").cast("long").alias("no"), "line")
