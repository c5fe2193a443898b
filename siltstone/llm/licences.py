"""Licence scan by canonical digests.

A text is brought to a canonical form in which copies of one licence agree: no
copyright notices, lower case, one spelling of equivalent words, no punctuation, single blanks. The SHA-256
of the whole form is joined to the digests of the known licences. No part of a text matches,
only a text that is a licence from end to end.
"""

from __future__ import annotations

from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the same meaning to a licence, brought to the right-hand spelling.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("organisations", "organizations"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"),
    ("merchantibility", "merchantability"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("noncommercial", "non commercial"), ("noninfringement", "non infringement"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
]
#: Words that follow "copyright" where a line of a licence's own text begins with it.
BODY = "notices?|holders?|owners?|laws?|interests?|licen[sc]es?|statements?|and|or|in|to|of|as|is|that|which|on|by|under|resulting|infringement|treaty|disclaimer|permission"
#: Where the text of a licence begins behind a notice on the same line.
BEGIN = "permission is hereby granted|permission to use|redistribution and use|this software is provided|everyone is permitted to copy|this (?:program|library) is free software|licensed under the"
_START = r"(^|\n)[ \t#*/;-]*"
#: What is done to a text with notices, for Spark and SQL alike: a pattern and what comes in its place. A licence's text
#: begins a line; lines of the text itself that begin with "copyright" are marked; a line goes that tells a holder, by "copyright" with (c),
#: the sign, a year or a name, by (c) with a year, or by the sign; and a line "All rights reserved".
NOTICES = [
    (rf"(?i)({BEGIN})", "\n\\1"),
    (rf"(?i)(^|\n)([ \t#*/;-]*)(copyright[ \t]+(?:{BODY})\b)", r"\1\2|\3"),
    (_START + r"(?:(?i:copyright)[ \t]*(?:\((?i:c)\)|©|[0-9<\[{])|C(?i:opyright)[ \t]+\p{Lu}|\((?i:c)\)[ \t]*(?:[0-9]|(?i:copyright))|©)[^\n]*", r"\1"),
    (rf"(?i){_START}all rights reserved\.?[ \t\r]*(\n|\z)", "\\1\n"),
]
#: Texts without any of these (lowered) have no notices.
SIGNS = ("copyright", "(c)", "©", "all rights reserved")
TITLES = {"mit": "MIT", "isc": "ISC", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "zlib": "Zlib", "unlicense": "Unlicense", "0bsd": "0BSD"}
#: Canonical digests of longer licences, whole and, where they have one, without the appendix on how to apply them.
DIGESTS = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-1.0", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("Artistic-1.0", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
]


def canonical(text: Column) -> Column:
    """The canonical form; null stays null, and a text of copyright lines and punctuation alone becomes empty."""
    signs = reduce(lambda a, b: a | b, [F.lower(text).contains(s) for s in SIGNS])
    bare = text
    for pattern, place in NOTICES:
        bare = F.regexp_replace(bare, pattern, place.replace("\\", "$"))
    plain = F.regexp_replace(F.lower(F.when(signs, bare).otherwise(text)), r"[^\p{L}\p{N}]+", " ")
    plain = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for word, same in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {word} "), F.lit(f" {same} "))
    return F.trim(plain)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null for nulls and for forms without a word."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_texts() -> list[tuple[str, str]]:
    """The licences that come with the operator as texts: name and text, with and without its title line."""
    out = []
    for stem, name in TITLES.items():
        text = (files(__package__) / "licences" / f"{stem}.txt").read_text("utf-8")
        out.append((name, text))
        if "License" in text.split("\n", 1)[0]:
            out.append((name, text.split("\n", 1)[1]))
    return out


def scan(docs: DataFrame, text: str, licences: list[tuple[str, str]] | None = None, out: str = "licence") -> DataFrame:
    """``docs`` with ``canonical_sha256`` and ``out``, the name of the licence that the whole
    text is (else null; the first by name if two known texts agree). Nulls and texts without a word have neither. Every row and other
    column stays, repeated rows too; columns of these names are replaced. An empty table gives an empty table. ``licences`` are
    names and texts; without it, the known ones (``known_texts`` and ``DIGESTS``). The list is stated by the
    caller, so the broadcast is bounded by it and not by the corpus; more than 10,000 are
    joined without a broadcast."""
    spark = docs.sparkSession
    rows = known_texts() if licences is None else licences
    known = spark.createDataFrame(rows, "_name string, _text string").select("_name", digest(F.col("_text")).alias("_known")).where("_known is not null")
    if licences is None:
        known = known.union(spark.createDataFrame(DIGESTS, "_name string, _known string"))
    known = known.groupBy("_known").agg(F.min("_name").alias("_name"))
    known = F.broadcast(known) if len(rows) <= 10_000 else known
    hashed = docs.drop(out, "canonical_sha256").select(F.struct("*").alias("_row"), digest(F.col(text)).alias("canonical_sha256"))
    return hashed.join(known, F.col("canonical_sha256") == F.col("_known"), "left").select("_row.*", "canonical_sha256", F.col("_name").alias(out))


def op8_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical digest of every document, and the licence that it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, "text").select("doc_id", "canonical_sha256", "licence")


def licences_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known texts under notices of a holder, and ``benchmark``: rows that match, and rows that don't."""
    rows = [(-1 - i, f"{n}", h + t) for i, ((n, t), h) in enumerate(_headed())]
    own = spark.createDataFrame(rows, "item_id long, want string, text string")
    other = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long").alias("item_id"), F.lit(None).cast("string").alias("want"), "text")
    return scan(own.union(other), "text").select("item_id", "want", "canonical_sha256", "licence")


def _headed() -> list[tuple[tuple[str, str], str]]:
    headers = ["", "Copyright (c) 2020 Someone\n\n", "// Copyright 2019 The Authors.\n// All rights reserved.\n\n", "(c) 2001 Somebody\nCopyright Someone Ltd.\n"]
    return [(known, header) for known in known_texts() for header in headers]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_form(text: str) -> str:
    bare = text
    for pattern, place in NOTICES:
        bare = f"regexp_replace({bare}, {_quoted(pattern)}, {_quoted(place)}, 'g')"
    plain = f"' ' || trim(regexp_replace(lower({bare}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    return "trim(" + reduce(lambda sql, w: f"replace({sql}, ' {w[0]} ', ' {w[1]} ')", SPELLINGS, plain) + ")"


def _sql_known() -> str:
    values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in known_texts())
    digests = ", ".join(f"({_quoted(n)}, {_quoted(d)})" for n, d in DIGESTS)
    return f"""known AS (SELECT min(name) AS licence, digest FROM (
SELECT name, sha256(form) AS digest FROM (SELECT name, {_sql_form('body')} AS form FROM (VALUES {values}) v(name, body)) WHERE form <> ''
UNION ALL SELECT name, digest FROM (VALUES {digests}) d(name, digest)) GROUP BY digest)"""


def oracle_sql() -> dict[str, str]:
    own = ", ".join(f"({-1 - i}, {_quoted(n)}, {_quoted(h + t)})" for i, ((n, t), h) in enumerate(_headed()))
    return {
        "op8_licence_digests": f"""
WITH {_sql_known()}, forms AS (SELECT doc_id, {_sql_form('text')} AS form FROM documents)
SELECT f.doc_id, CASE WHEN f.form <> '' THEN sha256(f.form) END AS canonical_sha256, k.licence
FROM forms f LEFT JOIN known k ON f.form <> '' AND sha256(f.form) = k.digest""",
        "licences_known": f"""
WITH {_sql_known()}, rows AS (SELECT item_id, want, text FROM (VALUES {own}) v(item_id, want, text)
UNION ALL SELECT item_id, NULL, text FROM benchmark), forms AS (SELECT item_id, want, {_sql_form('text')} AS form FROM rows)
SELECT f.item_id, f.want, CASE WHEN f.form <> '' THEN sha256(f.form) END AS canonical_sha256, k.licence
FROM forms f LEFT JOIN known k ON f.form <> '' AND sha256(f.form) = k.digest"""}
