"""URL rules and a block list behind a blocked Bloom filter.

A rule names a host and a path; it fits the host with its subdomains and every path that begins
with its own, and the longest fitting rule decides. A url without a rule is judged by the list:
its canonical form is looked up in a blocked Bloom filter (one 256-bit block per url, two bits in
each of its four words), and only possible hits meet the exact list in a hash join, which removes
false positives. The filter has 16 bits per listed url and is broadcast only up to
`BROADCAST_BYTES`; a larger one is joined by block number.

Defined cases: a null url, or one without `://`, has an empty host and path, is never listed and
is allowed; repeated pages are judged alike; an empty list allows all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.sources.scratch import materialize

BITS_PER_URL, BLOCK_BITS, WORDS = 16, 256, 4
BROADCAST_BYTES = 32 << 20
NO_BLOCKS = 4_096  # numbers over which rows without a key are spread
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without closing slashes, other than tracking parameters sorted; null without host."""
    query = F.split(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), "&")
    kept = F.array_sort(F.filter(query, lambda x: (x != "") & ~x.rlike(TRACKING)))
    site = F.regexp_replace(host(url), r"^www\.", "")
    whole = F.concat(
        site, F.regexp_replace(path(url), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    )
    return F.when(site != "", whole)


def longest_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of (verdict, host, path) that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


# --- blocked Bloom filter -------------------------------------------------------------------------


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _mask(key: Column, word: int) -> Column:
    """Two bits of one 64-bit word, from a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return bit(12 * word).bitwiseOR(bit(12 * word + 6))


def bloom(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """Rows (_bloom_block, _bloom_w0, ...) of the blocks that hold bits; combined before the shuffle."""
    return listed.groupBy(_block(F.col(key), n_blocks).alias("_bloom_block")).agg(
        *[F.bit_or(_mask(F.col(key), i)).alias(f"_bloom_w{i}") for i in range(WORDS)]
    )


def blocks_for(n_keys: int) -> int:
    return max(1, -(-n_keys * BITS_PER_URL // BLOCK_BITS))


def possible(rows: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """`rows` with `_possible`: false only where the key is not listed."""
    n_blocks = blocks_for(listed.count())
    filter_ = bloom(listed, listed_key, n_blocks)
    if n_blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        filter_ = F.broadcast(filter_)
    hit = reduce(
        lambda a, b: a & b,
        [F.col(f"_bloom_w{i}").bitwiseAND(_mask(F.col(key), i)) == _mask(F.col(key), i) for i in range(WORDS)],
    )
    # rows without a key are in no block; they are spread over numbers that no block has
    nowhere = F.lit(-1).cast("bigint") - F.monotonically_increasing_id() % NO_BLOCKS
    joined = rows.withColumn("_bloom_block", F.coalesce(_block(F.col(key), n_blocks).cast("bigint"), nowhere)).join(filter_, "_bloom_block", "left")
    return joined.withColumn("_possible", F.coalesce(hit, F.lit(False))).drop("_bloom_block", *[f"_bloom_w{i}" for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """`pages` (any columns, with url) and `listed` (url): adds `_host`, `_path`, `_rule`, `_verdict`."""
    keys = materialize(listed.select(canonical(F.col("url")).alias("_listed")).where(F.col("_listed").isNotNull()).distinct(), "url-keys")
    rows = (
        pages.withColumn("_host", host(F.col("url")))
        .withColumn("_path", path(F.col("url")))
        .withColumn("_fit", longest_rule(F.col("_host"), F.col("_path"), rules))
        .withColumn("_canonical", canonical(F.col("url")))
    )
    tested = possible(rows, "_canonical", keys, "_listed")
    hits = tested.where("_possible").join(
        keys.select(F.col("_listed").alias("_canonical"), F.lit(True).alias("_found")), "_canonical", "left"
    )
    both = hits.unionByName(tested.where("NOT _possible").withColumn("_found", F.lit(None).cast("boolean")))
    by_list = F.when(F.col("_found"), F.lit("block")).otherwise(F.lit("allow"))
    return (
        both.withColumn("_rule", F.col("_fit.rule"))
        .withColumn("_verdict", F.coalesce(F.col("_fit.verdict"), by_list))
        .drop("_fit", "_canonical", "_possible", "_found")
    )
