"""URL filters: a Bloom filter cascade, exact over the corpus's own keys.

Level 1 encodes the listed keys. Scanning every key of the corpus (the universe) finds the keys that
pass it without being listed; level 2 encodes those, level 3 the listed keys that pass level 2, and so on
until no key is wrong. A key of the universe is then listed if the first level that it fails is an even
one (failing level 1 means not listed). Judging a url is a few bit tests of literals, without a join.

A level's bits are a literal of the plan. Their number follows the listed keys (level 1) and the
false positives (a small part of the universe), and is checked against ``MOST_BITS``; a list of more than about 8 million
keys raises, as its bits would be too much to send to every task.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the method's
verdict, allow; equal rows give equal rows; an empty table gives an empty result; urls are judged whole, whatever the length of the host or the path; columns
host, path, rule and verdict of the input are replaced, all others kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_staged, staged, table

#: (verdict, host, path prefix); a rule holds for its host and all subdomains.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hosts blocked with their subdomains where no rule fits: two of these words, in either order, below each parent.
LISTED_WORDS = ("spam", "farm", "cheap", "pills", "free", "bets", "casino", "win", "poker", "slots", "loans", "cash", "credit", "click", "clicks", "deals", "discount", "lottery", "prize", "bonus", "crypto", "coins", "adult", "dating", "replica", "watches", "essay", "diet", "traffic", "links", "seo", "bet")
LISTED_PARENTS = ("example.com", "example.net", "example.org")
LISTED_HOSTS = tuple(f"{a}-{b}.{parent}" for a in LISTED_WORDS for b in LISTED_WORDS if a != b for parent in LISTED_PARENTS)
#: Bits per key and hashes of a level; about one key in 50 passes wrongly.
BITS_PER_KEY, HASHES = 8, 6
#: 8 MB of bits at most in one level.
MOST_BITS = 1 << 26
#: Levels at most; each keeps about one wrong key in 50, so even 2**64 keys need fewer.
MOST_LEVELS = 40


def host_and_path(url: Column) -> tuple[Column, Column]:
    # the first :// counts, further ones belong to the rest
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int], most: int) -> Column:
    """Every ``host suffix + path prefix`` that a listed key could be, longest host and then path first.

    No listed host has more than ``most`` labels, so longer suffixes are no keys: a host of any length has that many at most.
    """
    labels = F.least(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1, F.lit(most))
    suffixes = F.transform(F.filter(F.array(*[F.lit(n) for n in range(most, 0, -1)]), lambda n: n <= labels), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    heads = F.filter(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


def _positions(key: Column, level: int, bits: int) -> Column:
    """The key's bit positions: two hashes, combined; other hashes in each level."""
    a, b = [F.pmod(F.xxhash64(key, F.lit(2 * level + i)), F.lit(1 << 40)) for i in (0, 1)]
    return F.transform(F.array(*[F.lit(i) for i in range(HASHES)]), lambda i: F.pmod(a + i * b, F.lit(bits)))


def _encode(keys: DataFrame, level: int) -> tuple[int, Column] | None:
    """(number of bits, the bits as a literal array of longs) of the keys; None if there are none."""
    n = keys.count()
    if not n:
        return None
    bits = max(64, 1 << math.ceil(math.log2(n * BITS_PER_KEY)))
    if bits > MOST_BITS:
        raise ValueError(f"level {level} would need {bits} bits; the bound is {MOST_BITS}")
    at = keys.select(F.explode(_positions(F.col("key"), level, bits)).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    full = [0] * (bits // 64)
    for r in words.collect():  # bits / 64 rows at most
        full[r["w"]] = r["v"]
    # one foldable literal, so that large levels make no large tree
    return bits, F.from_json(F.lit(str(full)), "array<bigint>")


def _passes(key: Column, level: int, coded: tuple[int, Column]) -> Column:
    bits, words = coded
    return F.forall(_positions(key, level, bits), lambda p: F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0)


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[tuple[int, Column]]:
    """Levels that tell exactly which keys of ``universe`` (key) are in ``listed`` (key).

    The joins here are on the few keys that are wrong so far; judging needs none.
    """
    universe = staged(universe.select("key").distinct(), "url-keys")
    wrong, levels = staged(listed.select("key").distinct(), "url-listed"), []
    inside, outside = wrong, universe.join(F.broadcast(wrong) if wrong.count() <= 100_000 else wrong, "key", "left_anti")
    while len(levels) < MOST_LEVELS:
        coded = _encode(wrong, len(levels))
        if coded is None:
            break
        # keys of the other side that pass this level must be told apart by the next
        other = outside if len(levels) % 2 == 0 else inside
        found = staged(other.where(_passes(F.col("key"), len(levels), coded)), "url-wrong")
        if len(levels) % 2 == 0:
            outside = found
        else:
            inside = found
        levels.append(coded)
        wrong = found
    else:
        raise ValueError("the cascade did not end")
    drop_staged(universe)
    return levels


def listed_by(key: Column, levels: list[tuple[int, Column]]) -> Column:
    """Whether the cascade has ``key``: of the levels passed in a row, the number is odd."""
    out = F.lit(len(levels) % 2 == 1)
    for level in range(len(levels) - 1, -1, -1):
        out = F.when(_passes(key, level, levels[level]), out).otherwise(F.lit(level % 2 == 1))
    return out


def judge(pages: DataFrame, rules=RULES, listed_hosts=LISTED_HOSTS) -> DataFrame:
    """``pages`` (url and others) with host, path, rule and verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    by_rule = {h + p: (v, h + p) for v, h, p in rules}
    by_list = [h + "/" for h in dict.fromkeys(listed_hosts) if h + "/" not in by_rule]
    lengths = sorted({len(p) for _, _, p in rules} | {1})
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), host.alias("host"), path.alias("path"))
    most = max(k.split("/")[0].count(".") + 1 for k in [*by_rule, *by_list, ""])
    keys = candidate_keys(F.col("host"), F.col("path"), lengths, most)
    # a host without a path is as listed as its root
    keys = F.when(F.col("path") == "", candidate_keys(F.col("host"), F.lit("/"), [1], most)).otherwise(keys) if by_list else keys
    universe = rows.select(F.explode(keys).alias("key"))
    listed = spark.range(1).select(F.explode(F.split(F.lit("\n".join([*by_rule, *by_list])), "\n")).alias("key"))
    levels = build_cascade(universe, listed)
    rows = rows.withColumn("hits", F.filter(keys, lambda k: listed_by(k, levels)))
    names = F.create_map(*[x for k, (v, _) in by_rule.items() for x in (F.lit(k), F.lit(v))])
    ruled = F.array(*[F.lit(k) for k in by_rule])
    # a rule whose path is / needs a path; the root that stands for an empty path only serves the list
    fits = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.filter("hits", lambda k: F.array_contains(ruled, k)))
    longest = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    rows = rows.withColumn("rule", longest)
    # a rule's key that only the root of an empty path met is no listed host
    method = F.when(F.exists("hits", lambda k: ~F.array_contains(ruled, k)), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNotNull(), F.element_at(names, F.col("rule"))).otherwise(method)
    return rows.select(*[F.col("kept")[c].alias(c) for c in kept], "host", "path", "rule", verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_WORDS, _PARENTS = ", ".join(f"'{w}'" for w in LISTED_WORDS), ", ".join(f"'{p}'" for p in LISTED_PARENTS)
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP6_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (SELECT * FROM (VALUES {_RULES}) AS r(verdict, h, p)),
words AS (SELECT unnest([{_WORDS}]) AS w), parents AS (SELECT unnest([{_PARENTS}]) AS p),
listed AS (SELECT a.w || '-' || b.w || '.' || p AS l FROM words a, words b, parents WHERE a.w <> b.w),
blocked AS (SELECT DISTINCT host FROM parts JOIN listed ON host = l OR ends_with(host, '.' || l)),
fits AS (SELECT page_id, host, path, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.verdict, length(r.h || r.p)) AS ruled
         FROM parts JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.ruled, CASE WHEN p.host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path
"""
