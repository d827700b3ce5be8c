"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of 512 bits, eight 64-bit words each; a URL sets one bit in every word of
one block. Its number of blocks follows the list up to MAX_BLOCKS (8 MB of bits), which is the proven bound
of what is broadcast. A longer list only makes more URLs pass the filter: those that pass meet the list
itself in a hash join, so the result is exact at any size. URLs are made distinct before that join, so that
a URL with a third of all rows is looked up once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmap.llm.common import lower_ascii, materialize

BITS_A_URL = 12
MAX_BLOCKS = 1 << 17
WORDS = 8

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased. Null or no :// gives ''."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ? or # or the end. Null or no :// gives ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. and without a port, path without its trailing slashes and index page.
    Scheme, query and fragment don't count."""
    name = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^www\.", "")
    return F.concat(name, F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", ""), r"/+$", ""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (host and path together) that fits, as a struct of rule and verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _bit(url: Column, word: int) -> Column:
    """The bit that url sets in one word of its block: six bits of a second hash of it."""
    place = F.shiftright(F.xxhash64(url, F.lit("bits")), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of the column url of listed: block, w0 ... w7. At most `blocks` rows."""
    url = F.col("url")
    bits = listed.select(_block(url, blocks).alias("block"), *[_bit(url, k).alias(f"w{k}") for k in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, listed.

    listed: a column url of canonical URLs; nulls and repeats in it don't count. The verdict is that of the
    longest fitting rule, else block for a listed URL, else allow. Null URLs and those without :// have an
    empty host and path, fit no rule, and are allowed unless '' is listed. Of rules that fit equally long there are none, as a host and path are one rule. Repeated rows
    keep a row each. Very long URLs are looked at whole. An empty table gives no rows. Other columns of pages are not looked at.
    """
    listed = materialize(listed.select("url").where("url is not null").distinct(), "url-list")
    blocks = min(MAX_BLOCKS, max(1, -(-listed.count() * BITS_A_URL // (64 * WORDS))))
    parts = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    parts = parts.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    probes = parts.join(F.broadcast(bloom(listed, blocks)), _block(F.col("canonical"), blocks) == F.col("block"), "left")
    hit = reduce(Column.__and__, [F.col(f"w{k}").bitwiseAND(_bit(F.col("canonical"), k)) != 0 for k in range(WORDS)])
    probes = probes.select("page_id", "host", "path", "canonical", F.coalesce(hit, F.lit(False)).alias("maybe"))

    # The exact check: of distinct URLs that passed the filter, those on the list.
    sure = (
        probes.where("maybe").select(F.col("canonical").alias("url")).distinct().join(listed.hint("shuffle_hash"), "url", "left_semi")
    )
    sure = sure.select(F.col("url").alias("canonical"), F.lit(True).alias("listed"))
    passed = probes.where("maybe").join(sure, "canonical", "left")
    rest = probes.where("not maybe").withColumn("listed", F.lit(False))
    cols = ["page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")]
    judged = passed.select(*cols).unionByName(rest.select(*cols)).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "listed")
