"""URL filter: a cascade of Bloom filters tells, without a join, exactly which hosts are listed.

Level 0 encodes the listed keys. Level 1 encodes the keys of the complete universe that level 0 takes for
listed although they are not, level 2 the listed keys that level 1 takes for such false positives, and so on
until a level lets nothing wrong through. A key is listed if the first level that does not hold it is an
odd one. As the universe holds every key that will be asked for, the answer is exact.

A filter is a row of 64-bit words, made by one aggregation and handed to the scan as a scalar subquery. Its
size is checked: beyond ``MAX_FILTER_BITS`` the keys are split by hash into passes, each with a cascade of
its own over its own part of the rows, so that no more than one bounded filter per level is ever broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyflow.llm.common import stage

#: Bits for each key of a level and hash functions; about one key in 22 is a false positive.
BITS_PER_KEY = 8
HASHES = 3
#: Bits of the largest filter that is handed to the executors: 16 MB.
MAX_FILTER_BITS = 1 << 27
#: Words of a filter that are put in order together.
CHUNK = 1 << 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: str) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits a host or one of its parents; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


def _filter(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with the words of a filter, those without a bit too: every word has a row before they are put in order."""
    hit = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, i, bits) for i in range(HASHES)])).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = hit.select(F.expr("bit div 64").alias("word"), one.alias("bits")).union(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = lambda at: F.transform(F.array_sort(F.collect_list(F.struct(at, "bits"))), lambda w: w["bits"])
    chunks = words.groupBy(F.expr(f"word div {CHUNK}").alias("chunk")).agg(in_order("word").alias("bits"))
    # At most bits / 64 words, a number that was checked.
    return chunks.agg(F.flatten(in_order("chunk")).alias("words"))


def _holds(key: Column, words: Column, level: int, bits: int) -> Column:
    def bit(i: int) -> Column:
        at = _bit(key, level, i, bits)
        word = F.get(words, F.call_function("div", at, F.lit(64).cast("bigint")).cast("int"))
        return F.coalesce(F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))

    return reduce(lambda a, b: a & b, [bit(i) for i in range(HASHES)])


def _bits(n: int) -> int:
    return max(64, -(-n * BITS_PER_KEY // 64) * 64)


class Cascade:
    """Built from the complete universe: ``key``, ``listed``; each key once."""

    def __init__(self, universe: DataFrame, max_levels: int = 64) -> None:
        self.levels: list[tuple[Column, int]] = []
        one, other = universe.where(F.col("listed")).select("key"), universe.where(~F.col("listed")).select("key")
        left = one.count()
        for level in range(max_levels):
            if not left:
                return
            bits = _bits(left)
            # Written down: a level's keys depend on all levels before, which would be made again in each later one.
            words = stage(_filter(one, level, bits), "url-filter").scalar()
            self.levels.append((words, bits))
            # What this level takes for its own although it is not goes into the next one.
            one, other = other.where(_holds(F.col("key"), words, level, bits)), one
            left = one.count()
        raise ValueError("two keys of the universe share all hashes of every level")

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            words, bits = self.levels[level]
            out = F.when(_holds(key, words, level, bits), out).otherwise(F.lit(level % 2 == 1))
        return out


def with_listed(rows: DataFrame, listed: DataFrame, key: str, out: str, max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``rows`` with the boolean ``out``: whether ``key`` is one of ``listed``'s keys (its first column).

    Null keys are never listed. Repeated keys count once; empty tables give an empty or all-false result.
    """
    wanted = listed.select(F.col(listed.columns[0]).alias("key")).where("key is not null")
    asked = rows.select(F.col(key).alias("key")).where("key is not null")
    universe = stage(
        wanted.select("key", F.lit(1).alias("l")).union(asked.select("key", F.lit(0))).groupBy("key")
        .agg((F.max("l") == 1).alias("listed")),
        "url-keys",
    )
    # The larger of the first two levels decides: listed keys, or what passes for them.
    n_listed, n_other = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    passes = max(1, -(-_bits(max(n_listed, n_other // 16)) // max_bits))
    part = lambda col: F.pmod(F.xxhash64(col, F.lit("pass")), F.lit(passes))
    done = []
    for p in range(passes):
        cascade = Cascade(universe if passes == 1 else universe.where(part(F.col("key")) == p))
        mine = rows if passes == 1 else rows.where(F.coalesce(part(F.col(key)), F.lit(0)) == p)
        done.append(mine.withColumn(out, F.when(F.col(key).isNull(), False).otherwise(cascade.listed(F.col(key)))))
    return reduce(DataFrame.union, done)


def judge_urls(pages: DataFrame, rules: list[Rule], listed_hosts: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page: its longest rule's verdict, else block if its
    host is listed and allow if not.

    A null url, or one without ``://``, has an empty host and path. Every row of ``pages`` comes out, repeated
    ones too; other columns are left behind.
    """
    split = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    marked = with_listed(split, listed_hosts, "host", "is_listed")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return marked.select(
        "page_id",
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"),
    )
