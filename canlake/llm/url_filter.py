"""URL filtering with a cascade of Bloom filters. DataFrame functions only.

A rule is a key ``host/path prefix``; it fits a URL whose host is that host or one of its
subdomains and whose path begins with the prefix.  The candidate keys of a URL are all
its host suffixes followed by the path prefixes of the lengths that rules have.  The
longest listed candidate decides.

Membership is decided by a cascade built over the complete key universe, that is the
distinct candidate keys of the whole corpus: level 1 holds the listed keys, level 2 the
unlisted keys that pass level 1, level 3 the listed keys that pass level 2, and so on,
until no key of the universe passes wrongly.  A key is looked up level by level until
one misses; the parity of that level is the exact answer for every key of the universe,
so no URL is joined with anything; only the distinct keys meet the table of rules once, when
the cascade is built.  Level 1 takes a hash and 1.5 bits per rule for every doubling of the universe
over the rules, so about as many other keys pass it as there are rules; later levels take
``BITS_PER_KEY`` bits for each key they hold.  All levels together are a few times the list of rules, which the caller
holds in memory anyway.

Null URLs and URLs without ``://`` have an empty host and path, match nothing and get
``default``.  Equal rows are judged each for itself; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm.common import table
from canlake.storage import settle

ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")
DEFAULT = "allow"
BITS_PER_KEY = 8
HASHES = 3


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes with path prefixes; a path shorter than a length gives no key of it."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1000 * level + i)), F.lit(bits))


class Level:
    """One Bloom filter, kept as an array of 64-bit words."""

    def __init__(self, keys: DataFrame, n: int, level: int, hashes: int = HASHES):
        self.level, self.hashes = level, hashes
        self.bits = 64 * max(1, -(-n * max(BITS_PER_KEY, 3 * hashes // 2) // 64))
        places = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, i, self.bits) for i in range(hashes)])).alias("bit"))
        words = places.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("value"))
        # As many words as the filter has at most: a few times the number of listed keys.
        value = {r["word"]: r["value"] for r in words.collect()}
        self.words = [value.get(w, 0) for w in range(self.bits // 64)]

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        tests = []
        for i in range(self.hashes):
            bit = _bit(key, self.level, i, self.bits)
            word = F.get(words, F.floor(bit / 64).cast("int"))
            tests.append(F.call_function("shiftright", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return reduce(Column.__and__, tests)


class Cascade:
    """Exact membership of the keys of ``universe`` in ``listed``.

    The first level has a hash for every doubling of the universe over the list, so about
    as many unlisted keys pass it as keys are listed: no later level is larger than the list needs, whatever the universe.
    """

    def __init__(self, universe: DataFrame, listed: list[str]):
        rules = universe.sparkSession.createDataFrame([(key, True) for key in sorted(set(listed))], "key string, listed boolean")
        marked = universe.join(rules, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("is_listed"))
        marked = settle(marked, "cascade-universe")
        self.levels: list[Level] = []
        holds, other = marked.where("is_listed"), marked.where("not is_listed")
        n = holds.count()
        hashes = max(HASHES, ceil(log2(marked.count() / n))) if n else HASHES
        while n:
            level = Level(holds, n, len(self.levels) + 1, HASHES if self.levels else hashes)
            self.levels.append(level)
            wrong = settle(other.where(level.passes(F.col("key"))), "cascade-wrong")
            holds, other, n = wrong, holds, wrong.count()

    def contains(self, key: Column) -> Column:
        """Walks the levels: the first that misses decides by its parity."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.passes(key), answer).otherwise(F.lit(level.level % 2 == 0))
        return answer


def judged(pages: DataFrame, allow: list[str], block: list[str], default: str = DEFAULT) -> DataFrame:
    """Adds host, path, rule and verdict to ``pages`` (url)."""
    rules = [*allow, *block]
    lengths = sorted({len(r) - r.index("/") for r in rules})
    named = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    candidates = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = settle(named.select(F.explode(candidates).alias("key")).distinct(), "url-keys")
    listed = Cascade(universe, rules)
    blocked = Cascade(settle(universe.where(listed.contains(F.col("key"))), "url-listed"), block)
    hits = F.filter(candidates, listed.contains)
    # Longest key first; of two equally long ones the one with the longer host, then the greater.
    longest = F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("host"), k.alias("key"))))
    found = named.withColumn("rule", longest["key"])
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.contains(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("verdict", verdict)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, list(ALLOW), list(BLOCK)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH parsed AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path
  FROM parsed
), rules(host_rule, path_rule, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, arg_max(host_rule || path_rule, length(host_rule || path_rule)) AS rule,
         arg_max(action, length(host_rule || path_rule)) AS action
  FROM named JOIN rules ON (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule)
  GROUP BY page_id
)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM named n LEFT JOIN fits f USING (page_id)
"""
