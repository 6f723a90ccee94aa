"""URL filters: a blocked Bloom filter of the listed canonical URLs in front of an exact hash join.

A rule is a host and a path prefix with a verdict; its canonical URL is ``host + path``. A url's candidates are all
pairs of a suffix of its host (whole labels) and a prefix of its path as long as some rule's host (in labels) and path. Each
candidate is hashed once: some bits of the hash name a block of the filter, others the bits within it. A block is one
row with the set bits in eight 64-bit words, so the filter is a table and its probe an equi-join; only candidates
with all bits set go on to the join with the rules themselves, which removes the false positives. The rule with the
longest canonical URL wins, and of these the longer host, the allowing one, and the first by text.

Both tables are as large as the list of rules, not the urls. They are broadcast where their counted rows stay under
``broadcast_rows``, and joined by shuffle beyond. Urls are reduced to distinct (host, path) first, so a page that a
third of all rows name is judged once.

Defined results: a null url, or one without ``://``, has an empty host and path. Urls that no rule fits get the
default verdict and a null rule. Repeated rows, null ids and all other columns are kept as they are. Rules with a null
host, path or verdict are an error; an empty list judges all urls by default. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of 64 bits in a block, and bits set in it for a key.
BLOCK_WORDS, KEY_BITS = 8, 6
#: Keys for which a block has room: 512 bits for 32 keys let through about one of two thousand others.
BLOCK_KEYS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path up to ``?`` or ``#``."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _blocks(n: int) -> int:
    return max(1, -(-n // BLOCK_KEYS))


def _block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks))


def _bits_of(key: Column) -> Column:
    """The places 0 to 511 of a key's bits, cut from one hash of 64 bits."""
    places = [F.shiftright(F.xxhash64(key, F.lit(1)), 9 * n).bitwiseAND(F.lit(64 * BLOCK_WORDS - 1)).cast("int") for n in range(KEY_BITS)]
    return F.array_distinct(F.array(*places))


def bloom_blocks(keys: DataFrame, key_col: str, n: int) -> DataFrame:
    """The filter as a table: block, and words, an array of 64-bit integers."""
    key = F.col(key_col)
    bits = keys.select(_block_of(key, _blocks(n)).alias("block"), F.explode(_bits_of(key)).alias("bit"))
    word = F.shiftright("bit", 6)
    words = [F.coalesce(F.bit_or(F.when(word == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63))))), F.lit(0).cast("long")) for k in range(BLOCK_WORDS)]
    return bits.groupBy("block").agg(F.array(*words).alias("words"))


def may_hold(words: Column, key: Column) -> Column:
    """Whether all bits of a key are set in its block's words."""

    def is_set(bit: Column) -> Column:
        word = F.element_at(words, F.shiftright(bit, 6) + 1)
        return F.call_function("shiftrightunsigned", word, bit.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1

    return F.forall(_bits_of(key), is_set)


def _candidates(host: Column, path: Column, sizes: list[int], lengths: list[int]) -> Column:
    """(host suffix, path prefix) of the suffixes with as many labels as some rule's host has, and of the prefixes that
    are as long as some rule's path."""
    labels = F.split(host, r"\.")
    own = F.filter(F.array(*(F.lit(n) for n in sizes)).cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(own, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.char_length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.struct(s.alias("host"), F.substring(path, F.lit(1), n).alias("path")))))


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", broadcast_rows: int = 500_000) -> DataFrame:
    """Adds host, path, rule and verdict. ``rules`` has host, path and verdict."""
    clash = {"host", "path", "rule", "verdict"} & set(pages.columns)
    pages = pages.drop(*clash)
    host, path = host_and_path(F.col(url_col))
    judged = pages.withColumns({"host": host, "path": path})

    listed = rules.select("host", "path", "verdict").distinct()
    counted = listed.agg(F.count("*").alias("n"), F.max(F.expr("host IS NULL OR path IS NULL OR verdict IS NULL")).alias("bad"), F.array_sort(F.collect_set(F.char_length("path"))).alias("lengths"), F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))).alias("sizes")).first()
    if counted.bad:
        raise ValueError("a rule without host, path or verdict")
    small = (lambda df: F.broadcast(df)) if counted.n <= broadcast_rows else (lambda df: df)

    key = _key(F.col("host"), F.col("path"))
    blocks = bloom_blocks(listed.select(key.alias("key")).distinct(), "key", counted.n)
    urls = judged.select("host", "path").distinct()
    candidates = urls.select(F.col("host").alias("url_host"), F.col("path").alias("url_path"), F.explode(_candidates(F.col("host"), F.col("path"), counted.sizes, counted.lengths)).alias("c")).select("url_host", "url_path", "c.host", "c.path")
    probed = candidates.withColumn("block", _block_of(key, _blocks(counted.n)))
    possible = probed.join(small(blocks), "block").where(may_hold(F.col("words"), key)).select("url_host", "url_path", "host", "path")
    hits = possible.join(small(listed), ["host", "path"])
    rank = F.struct(F.char_length(key).alias("a"), F.char_length("host").alias("b"), (F.col("verdict") == "allow").alias("c"))
    best = hits.groupBy("url_host", "url_path").agg(F.max_by(F.struct(key.alias("rule"), "verdict"), F.struct(rank, key)).alias("best"))
    best = best.select(F.col("url_host").alias("host"), F.col("url_path").alias("path"), "best.rule", "best.verdict")
    joined = judged.join(best, ["host", "path"], "left")
    return joined.select(*pages.columns, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
