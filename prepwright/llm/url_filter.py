"""URL lists: a blocked Bloom filter before an exact join, and host and path rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepwright.llm.common import ascii_lower, free_names, ship_package, stored

# A block is eight 32-bit words; a key sets one bit in each.
WORDS = 8
BITS_PER_KEY = 12
# The filter is broadcast. A list beyond this bound gets a filter of this size, which lets more
# rows through to the exact join and changes no result.
MAX_BLOCKS = 1 << 19   # 16 MB
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


@dataclass(frozen=True)
class Rule:
    """``host/path``, and whether what it fits is let in."""

    pattern: str
    allow: bool

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or a default port, path without a last ``/``, other than tracking parameters
    in order. Null if there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""),
                                       F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _masks(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each 64-bit key by its high half, and the bit in each word by its low half."""
    high, low = (keys >> np.uint64(32)), keys.astype(np.uint32)
    at = ((high * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
    return at, np.uint32(1) << ((low[:, None] * SALTS) >> np.uint32(27))


def bloom_filter(listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """Words of the blocked filter, (blocks, 8), of a column of 64-bit hashes ``key``.

    Bits are set inside Spark and combined by block; the driver gets the filter, 16 MB at most.
    """
    ship_package(listed.sparkSession)
    keys = listed.count()
    blocks = min(max_blocks, max(1, -(-keys * BITS_PER_KEY // (32 * WORDS))))

    def bits(batches):
        for frame in batches:
            at, masks = _masks(frame["key"].to_numpy().view(np.uint64), blocks)
            yield pd.DataFrame({"block": at} | {f"w{i}": masks[:, i].astype(np.int64) for i in range(WORDS)})

    schema = "block bigint, " + ", ".join(f"w{i} bigint" for i in range(WORDS))
    rows = listed.select("key").mapInPandas(bits, schema).groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).toPandas()
    words = np.zeros((blocks, WORDS), np.uint32)
    words[rows["block"].to_numpy()] = rows[[f"w{i}" for i in range(WORDS)]].to_numpy().astype(np.uint32)
    return words


def listed_rows(df: DataFrame, url: str, urls: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Add ``listed``: whether the row's canonical URL is one of ``urls`` (column ``url``).

    The filter passes every listed URL and a few others; only these rows move, to an exact hash join
    on the canonical URL that removes the false ones. The list has one row per URL there, so a URL that
    holds much of the table is split on the side of the rows. A missing URL is not listed, and a list
    that is empty lists nothing. A column ``listed`` of ``df`` is replaced.
    """
    urls = stored(urls.select(canonical(F.col("url")).alias("url")).filter("url is not null").distinct(), "listed-urls")
    words = df.sparkSession.sparkContext.broadcast(bloom_filter(urls.select(F.xxhash64("url").alias("key")), max_blocks))

    @F.pandas_udf("boolean")
    def passes(keys: pd.Series) -> pd.Series:
        at, masks = _masks(keys.to_numpy().view(np.uint64), len(words.value))
        return pd.Series(((words.value[at] & masks) == masks).all(axis=1))

    key, may, found = free_names(df, "canonical", "passes", "found")
    rows = df.withColumn(key, canonical(F.col(url)))
    rows = stored(rows.withColumn(may, F.col(key).isNotNull() & passes(F.xxhash64(key))), "filtered-urls")
    exact = urls.hint("shuffle_hash").select(F.col("url").alias(key), F.lit(True).alias(found))
    certain = rows.filter(F.col(may)).join(exact, key, "left").withColumn("listed", F.col(found).isNotNull())
    rest = rows.filter(~F.col(may)).withColumn("listed", F.lit(False))
    columns = [*[F.col(f"`{c}`") for c in df.columns if c.lower() != "listed"], "listed"]
    return certain.select(*columns).unionAll(rest.select(*columns))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Pattern of the longest rule that fits, else null; of two as long the one with the longer host."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), len(r.host), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.pattern)).otherwise(found)
    return found


def judged(pages: DataFrame, urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed. A rule decides; without one, a listed URL is blocked.

    A missing URL, or one without ``://``, has an empty host and path and is allowed. Repeated pages give
    a row each; columns of ``pages`` other than page_id and url are not looked at.
    """
    rows = listed_rows(pages.select("page_id", "url"), "url", urls)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "listed").withColumn(
        "rule", rule_for(F.col("host"), F.col("path"), rules))
    allowed = F.lit(False)
    for rule in rules:
        allowed = F.when(F.col("rule") == rule.pattern, F.lit(rule.allow)).otherwise(allowed)
    allow = F.when(F.col("rule").isNotNull(), allowed).otherwise(~F.col("listed"))
    return rows.withColumn("verdict", F.when(allow, F.lit("allow")).otherwise("block")).select(
        "page_id", "host", "path", "rule", "verdict", "listed")
