"""Licence scans by canonical digests: entire texts, and entire lines, are looked up among those of known licences.

The canonical form has copyright lines dropped, letters in lower case, equivalent spellings made one, every run of other
characters than letters and digits made a space. Its SHA-256 digest is joined with the digests of known texts. The lines
that name a licence are compared, each as a whole, with known notices. Known texts are put into the same form by the
same expression, so a text's own wording decides alone.

DataFrame functions only. Known texts and notices may be tables of any size; a side is broadcast only if it has been counted and
is small. Defined results: a null text is an empty one and, as it has no letter, no licence; repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, small
from .license_texts import DIGESTS, known_notices, known_texts

#: Spellings that stand for one another (pattern, what is written).
SPELLINGS = ((r"\blicence(d|s)?\b", "license$1"), (r"\bunlicence\b", "unlicense"), (r"\bsub ?licence\b", "sublicense"), (r"\bcopyright owner(s)?\b", "copyright holder$1"), (r"\bnon ?commercial\b", "noncommercial"), (r"\bnon ?infringement\b", "noninfringement"), (r"\backnowledgement\b", "acknowledgment"), (r"\bmerchantibility\b", "merchantability"), (r"\bpercent\b", "per cent"), (r"\bwilful\b", "willful"), (r"\bhttps\b", "http"))
COPYRIGHT_LINES = r"(?im)^[^\p{L}\p{N}\n]*(?:(?:portions[ \t]+)?copyright\b[^\n]*(?:[12][0-9]{3}|\(c\)|\x{A9})|\(c\)|\x{A9}|all[ \t]+rights[ \t]+reserved)[^\n]*$"
NAMES_LICENCE = r"(?i)licen[cs]e"


def canonical(text: Column, lines: bool = True) -> Column:
    out = F.regexp_replace(text, COPYRIGHT_LINES, " ") if lines else text
    out = F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}]+", " "))
    spelled = out
    for pattern, written in SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, written)
    # Only what can be a licence is spelled anew.
    return F.when(out.rlike("licen[cs]e|copyright|warrant"), spelled).otherwise(out)


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


def known_digests(known: DataFrame) -> DataFrame:
    """Rows (digest, license_id) of known texts (license_id, text); of equal texts the first id in order."""
    return known.select(digest(canonical(F.col("text"))).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _table(spark: SparkSession, known: dict[str, list[str]] | DataFrame) -> DataFrame:
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame([(k, t) for k, texts in known.items() for t in texts], "license_id string, text string")
    return known_digests(rows.select("license_id", "text"))


def licenses(docs: DataFrame, texts: dict[str, list[str]] | DataFrame | None = None, notices: dict[str, list[str]] | DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest, license_id (of the entire text, or null), n_notices and notices
    (the distinct ids of known notices among its lines, sorted and joined by commas).

    ``texts`` and ``notices`` (tables of license_id and text, or lists by id) take the place of the known ones.
    """
    spark = docs.sparkSession
    whole = _table(spark, known_texts() if texts is None else texts)
    if texts is None:
        long = spark.createDataFrame([(d, k) for k, digests in DIGESTS.items() for d in digests], "digest string, license_id string")
        whole = whole.union(long).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    whole = durable(whole.select(F.col("digest").alias("_digest"), "license_id"))
    by_line = durable(_table(spark, known_notices() if notices is None else notices).select("digest", F.col("license_id").alias("name")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.when(F.col("text").rlike(NAMES_LICENCE), F.filter(F.split("text", "\n"), lambda x: x.rlike(NAMES_LICENCE)))
    found = docs.select("doc_id", text.alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(canonical(F.col("text"))).alias("digest"), F.transform(lines, lambda x: digest(canonical(x, lines=False))).alias("lines"))
    found = durable(found)
    named = found.select("row", F.explode("lines").alias("digest")).join(small(by_line), "digest")
    named = durable(named.groupBy("row").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices")))
    out = found.join(small(whole), F.col("digest") == F.col("_digest"), "left").join(small(named), "row", "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
