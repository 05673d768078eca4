"""URL filters by a cascade of Bloom filters; DataFrame functions only.

A cascade encodes a list of keys *exactly* with respect to a known universe of keys. Level 0 is a Bloom filter of the
listed keys; level 1 holds the keys of the universe that level 0 takes wrongly; level 2 the listed keys that level 1
takes wrongly; and so on until a level takes nothing wrongly. A key of the universe is listed if and only if the first
level that rejects it is odd (or all accept it and their number is odd). The universe is every key of the corpus, so
membership is exact and judging a page needs no join: the levels are binary literals in the plan.

Size: with r listed keys in a universe of s, level 0 has a false positive rate of about r / s, so level 1 encodes
about r keys, level 2 a sixteenth of the listed ones, and so on. All levels together take about
r * (1.44 * log2(s / r) + 7) bits, whatever the number of pages. Two hashes of each listed key and of what level 0 takes
wrongly, about 2 * r rows, come to the driver once, and all levels are set from them. ``MAX_LISTED`` bounds r and so the
literals; a longer list is matched exactly by a join of the distinct hosts and paths with the list.

Lists are tuples or tables with a column ``key``.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and the method's verdict for
"not listed" (allow). Repeated rows are judged each on its own. An empty table gives an empty result. A url whose
host has capitals A-Z is compared in lower case; other letters stay. Null keys of a list take no part, repeated ones
count once. Columns other than ``page_id`` and ``url`` take no part, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.runtime import durable, forget

MAX_LISTED = 1_000_000
#: Seven bits of each byte are used: such a byte is one ASCII character, which ``ascii`` reads without a cast to hex.
BITS = 7

#: False positive rate of the levels after the first: small, so that few levels follow.
LATER_RATE = 1 / 16

#: Rules as (host, path) written together; the first ``/`` ends the host.
BLOCK_RULES = ("net/", "example.com/de/")
ALLOW_RULES = ("example.net/en/", "org/fr/")
#: Hosts that are blocked where no rule fits: each name under each of the domains.
LISTED_NAMES = ("ads-track", "casino-win", "cheap-pills", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
LISTED_HOSTS = tuple(f"{n}.{d}" for n in LISTED_NAMES for d in LISTED_DOMAINS)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: after the first ``://`` up to ``/``, ``?``, ``#``; then up to ``?``, ``#``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key that a rule fitting this url can have: suffixes of the host times prefixes of the path.

    Structs (size, host_size, key): the largest struct is the longest rule, ties to the longer host.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    def of(n: int):
        def key(suffix: Column) -> Column:
            text = F.concat(suffix, F.substring(path, 1, n)) if n else suffix
            fits = (F.length(path) >= n) & (F.length(suffix) > 0)
            return F.when(fits, F.struct(F.length(text).alias("size"), F.length(suffix).alias("host_size"), text.alias("key")))

        return key

    each = [F.transform(suffixes, of(n)) for n in lengths]
    return F.array_distinct(F.filter(F.concat(*each), lambda c: c.isNotNull()))


@dataclass(frozen=True)
class Level:
    """A Bloom filter of a prime number of bits. Levels differ in it, so their bits are independent."""

    bits: int
    hashes: int
    data: bytes

    def accepts(self, first: Column, second: Column) -> Column:
        found = F.lit(True)
        for i in range(self.hashes):
            at = F.pmod(F.pmod(first, F.lit(self.bits)) + F.pmod(second, F.lit(self.bits)) * i, F.lit(self.bits))
            byte = F.ascii(F.substring(F.lit(self.data), (at / BITS).cast("int") + 1, F.lit(1)).cast("string"))
            found = found & (F.floor(byte / F.pow(F.lit(2), at % BITS)) % 2 == 1)
        return found

    def holds(self, key: tuple[int, int]) -> bool:
        return all(self.data[at // BITS] >> at % BITS & 1 for at in positions(key, self.bits, self.hashes))


def hashes_of(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def positions(key: tuple[int, int], bits: int, hashes: int) -> list[int]:
    """The bits of a key, by double hashing."""
    first, second = key[0] % bits, key[1] % bits
    return [(first + second * i) % bits for i in range(hashes)]


def _prime(least: int) -> int:
    n = max(67, least | 1)
    while any(n % d == 0 for d in range(3, math.isqrt(n) + 1, 2)):
        n += 2
    return n


def build_level(keys: list[tuple[int, int]], rate: float, taken: list[Level]) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = _prime(math.ceil(len(keys) * hashes / math.log(2)))
    while any(bits == level.bits for level in taken):
        bits = _prime(bits + 2)
    data = bytearray(bits // BITS + 1)
    for key in keys:
        for at in positions(key, bits, hashes):
            data[at // BITS] |= 1 << at % BITS
    return Level(bits, hashes, bytes(data))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        first, second = hashes_of(key)
        found = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            found = F.when(level.accepts(first, second), found).otherwise(F.lit(i % 2 == 1))
        return found


def build_cascades(universe: DataFrame, lists: list[DataFrame]) -> list[Cascade]:
    """A cascade for the ``key`` column of each list, over the distinct ``key`` column of ``universe``.

    One pass over the universe for all lists together. Null keys take no part. An empty list gives a cascade that
    contains nothing. A list of more than ``MAX_LISTED`` keys is refused: ``judge`` matches such lists by a join.
    """
    first, second = hashes_of(F.col("key"))
    numbers = (first.alias("first"), second.alias("second"))
    listed: list[dict[str, tuple[int, int]]] = []
    for keys in lists:
        rows = keys.where("key IS NOT NULL").select("key").distinct().select("key", *numbers).limit(MAX_LISTED + 1)
        listed.append({r["key"]: (r["first"], r["second"]) for r in rows.toLocalIterator()})
        if len(listed[-1]) > MAX_LISTED:
            raise ValueError(f"more than {MAX_LISTED} listed keys")
    size = universe.count()
    levels = [[build_level(list(own.values()), min(0.5, max(1e-9, len(own) / max(1, size))), [])] if own else [] for own in listed]
    passed = universe.select("key", *numbers).select("*", F.array(*(own[0].accepts(F.col("first"), F.col("second")) if own else F.lit(False) for own in levels)).alias("taken"))
    wrong: list[list[tuple[int, int]]] = [[] for _ in lists]
    for row in passed.where(F.array_contains("taken", True)).toLocalIterator():  # about twice the listed keys
        for i, taken in enumerate(row["taken"]):
            if taken and row["key"] not in listed[i]:
                wrong[i].append((row["first"], row["second"]))
    for own, keys, mistaken in zip(levels, listed, wrong):
        ours, others = list(keys.values()), mistaken
        while others:
            own.append(build_level(others, LATER_RATE, own))
            ours, others = others, [key for key in ours if own[-1].holds(key)]
    return [Cascade(tuple(own)) for own in levels]


def key_table(spark: SparkSession, keys: tuple[str, ...]) -> DataFrame:
    """A ``key`` column of literals."""
    if not keys:
        return spark.range(0, 0, 1, 1).select(F.lit("").alias("key"))
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, keys))).alias("key"))


Keys = tuple[str, ...] | DataFrame


def judge(pages: DataFrame, block: Keys = BLOCK_RULES, allow: Keys = ALLOW_RULES, listed_hosts: Keys = LISTED_HOSTS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``listed`` for every page.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest rule wins.
    Where none fits, pages of a listed host or of its subdomains are blocked, others allowed.
    """
    spark = pages.sparkSession
    lists = [x.select("key").where("key IS NOT NULL") if isinstance(x, DataFrame) else key_table(spark, tuple(x)) for x in (block, allow, listed_hosts)]
    if not lists[0].intersect(lists[1]).isEmpty():
        raise ValueError("a rule both blocks and allows")
    rules = lists[0].unionAll(lists[1])
    lengths = sorted({r[0] for r in rules.select(F.length("key") - F.instr("key", "/") + 1).distinct().collect()} | {0})  # lengths of paths
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = candidates(F.col("host"), F.col("path"), lengths)
    counts = [keys_.select("key").distinct().count() for keys_ in lists]
    short = [i for i, n in enumerate(counts) if n <= MAX_LISTED]
    universe = durable(parts.select(F.explode(keys.key).alias("key")).distinct())
    cascades = dict(zip(short, build_cascades(universe, [lists[i] for i in short])))
    forget(universe)
    names = ("block", "allow", "listed")
    hits = lambda cascade: lambda c: cascade.contains(c["key"])
    found = parts.withColumn("keys", keys)
    for i, name in enumerate(names):
        if i in cascades:
            found = found.withColumn(name, F.array_max(F.filter("keys", hits(cascades[i]))))
        else:  # exact for lists of any length: distinct hosts and paths, joined with the list
            each = parts.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("fit"))
            best = each.join(lists[i].distinct().withColumnRenamed("key", "own"), F.col("fit.key") == F.col("own")).groupBy("host", "path").agg(F.max("fit").alias(name))
            found = found.join(best, ["host", "path"], "left")
    blocks = F.col("block").isNotNull() & (F.col("allow").isNull() | (F.col("block") > F.col("allow")))
    listed = F.col("listed").isNotNull()
    verdict = F.when(blocks, "block").when(F.col("allow").isNotNull(), "allow").when(listed, "block").otherwise("allow")
    rule = F.when(blocks, F.col("block.key")).otherwise(F.col("allow.key"))
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), listed.alias("listed"))


def judge_sql(listed_hosts: tuple[str, ...] = LISTED_HOSTS) -> str:
    """The same rows in DuckDB SQL, with the rules written out."""
    fits = lambda h: f"(host = '{h}' OR ends_with(host, '.{h}'))"
    rule = "\n".join(
        f"WHEN {fits(r[: r.index('/')])} AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'"
        for r in sorted((*BLOCK_RULES, *ALLOW_RULES), key=len, reverse=True)
    )
    blocked = ", ".join(f"'{r}'" for r in BLOCK_RULES)
    listed = " OR ".join(map(fits, listed_hosts))
    return f"""
    WITH parts AS (
      SELECT page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
      FROM pages),
    ruled AS (SELECT *, CASE {rule} END AS rule, {listed} AS listed FROM parts)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
    FROM ruled"""
