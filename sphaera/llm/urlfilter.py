"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

The first level holds the listed keys. The keys of the corpus that it lets through by mistake are the
second level, the listed keys which that lets through are the third, and so on until a level makes no
mistake. Because the levels are built over every key that the corpus has, walking down them until one
says no gives exact membership, and no join. The first level's rate is chosen so that the second one is
about as small as the list; the size of all of them follows the list and the logarithm of the corpus.
A list beyond what a task should hold is dealt by hash over several cascades, each of which tells about the
keys of its part in a pass of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import ascii_lower, staged

#: The most bits of a first level, and so about half of what goes to a task in one pass: 8 MB.
MAX_LEVEL_BITS = 1 << 26
#: The least rate of mistakes that a first level is built for, and the bits that each of its keys then takes.
LEAST_RATE = 1e-6
BITS_PER_KEY = 29


@dataclass(frozen=True)
class Level:
    bits: bytes
    n_bits: int
    probes: int
    seed: int


def _places(key: Column, n_bits: int, probes: int, seed: int) -> list[Column]:
    first, step = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1))
    return [F.pmod(F.pmod(first, F.lit(n_bits)) + i * F.pmod(step, F.lit(n_bits)), F.lit(n_bits)) for i in range(probes)]


def in_level(key: Column, level: Level) -> Column:
    bits = F.lit(bytearray(level.bits))
    ok = F.lit(True)
    for p in _places(key, level.n_bits, level.probes, level.seed):
        byte = F.conv(F.hex(F.substring(bits, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        ok = ok & (F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1)
    return ok


def build_level(keys: DataFrame, key: str, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of n keys. Spark sets the bits; the driver gets them in rows of 32,768."""
    n_bits = max(64, math.ceil(max(n, 1) * math.log(1 / rate) / math.log(2) ** 2))
    probes = min(max(1, round(n_bits / max(n, 1) * math.log(2))), 24) if n else 1
    spots = keys.select(F.explode(F.array(*_places(F.col(key), n_bits, probes, seed))).alias("p"))
    # Bit numbers count from 1 there.
    rows = spots.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    out = bytearray(-(-n_bits // 32768) * 4096)
    for r in rows.collect():
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return Level(bytes(out[: (n_bits + 7) // 8]), n_bits, probes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, key: str = "key") -> list[Level]:
    """Levels that tell the listed keys of ``listed`` from all others of ``universe`` without a mistake.

    Null keys are in neither. Listed keys that the universe lacks are held as well.
    """
    yes = staged(listed.select(key).where(F.col(key).isNotNull()).distinct(), "listed")
    universe = universe.select(key).where(F.col(key).isNotNull())
    size = universe.agg(F.approx_count_distinct(key)).first()[0]
    levels: list[Level] = []
    inside, outside, n = yes, None, yes.count()
    while n:
        rate = min(0.5, max(LEAST_RATE, 0.7 * n / max(size, 1))) if not levels else 0.5
        level = build_level(inside, key, n, rate, len(levels))
        levels.append(level)
        others = universe.join(yes, key, "left_anti") if outside is None else outside
        wrong = staged(others.where(in_level(F.col(key), level)).distinct(), "wrong")
        inside, outside, n = wrong, inside, wrong.count()
    return levels


def build_cascades(listed: DataFrame, universe: DataFrame, key: str = "key", max_level_bits: int = MAX_LEVEL_BITS) -> list[list[Level]]:
    """Cascades for a list of any length: each has the keys of one part by hash, and about max_level_bits at most."""
    parts = max(1, -(-listed.count() * BITS_PER_KEY // max_level_bits))
    mine = lambda rows, i: rows if parts == 1 else rows.where(part_of(F.col(key), parts) == i)
    return [build_cascade(mine(listed, i), mine(universe, i), key) for i in range(parts)]


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))


def with_listed(rows: DataFrame, name: str, keys: Column, cascades: list[list[Level]]) -> DataFrame:
    """rows with the listed ones of an array of keys. Each cascade beyond the first takes a pass over rows."""
    out = rows.withColumn(name, F.array().cast("array<string>"))
    for i, levels in enumerate(cascades):
        own = lambda k: in_cascade(k, levels) if len(cascades) == 1 else (part_of(k, len(cascades)) == i) & in_cascade(k, levels)  # noqa: B023, E731
        out = out.withColumn(name, F.concat(name, F.filter(keys, own)))
        if len(cascades) > 1:
            out = staged(out, "listed")
    return out


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the depth at which the levels first say no decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        answer = F.when(in_level(key, levels[depth]), answer).otherwise(F.lit(depth % 2 == 1))
    return F.coalesce(answer, F.lit(False)) if levels else F.lit(False)


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(hosts: list[str]) -> int:
    """The most labels that one of the hosts has."""
    return max((h.count(".") + 1 for h in hosts), default=1)


def candidate_keys(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """Every key that could list a URL: each suffix of at most most_labels whole host labels, which is all that
    a list of such hosts can name, with each path prefix of a listed length."""
    # The last labels, by delimiter, so that a host of very many is cut and not split.
    labels = F.split(F.substring_index(host, ".", -most_labels), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(
    pages: DataFrame, allow: tuple[str, ...], block: tuple[str, ...], blocked_hosts: tuple[str, ...] = (), url: str = "url",
    max_level_bits: int = MAX_LEVEL_BITS,
) -> DataFrame:
    """pages with host, path, rule, verdict and listed.

    ``allow`` and ``block`` are rules "host/path-prefix"; a rule fits its host and all subdomains, the
    longest one wins, and block wins between equal ones. Without a rule, hosts in ``blocked_hosts`` and
    their subdomains are blocked (``listed``) and all else is allowed. Membership comes from Bloom cascades
    over all keys of pages. A null url, or one without "://", has an empty host and path and is allowed.
    Columns of pages named like a result are replaced; an empty table stays empty; repeated rows come back as
    they came. Hosts and paths may be of any length: only as many labels and characters as a rule has count.
    """
    spark = pages.sparkSession
    rules = sorted({*allow, *block})
    lengths = sorted({len(r) - r.index("/") if "/" in r else 0 for r in rules} | {0})
    results = ("host", "path", "rule", "verdict", "listed")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in results]
    judged = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def table(keys):
        return spark.createDataFrame([(k,) for k in keys], "key string")

    by_path = candidate_keys(F.col("host"), F.col("path"), lengths, labels_of([r.split("/", 1)[0] for r in rules]))
    by_name = candidate_keys(F.col("host"), F.lit(""), [0], labels_of(list(blocked_hosts)))
    places = judged.select("host", "path").distinct()
    rule_keys = staged(places.select(F.explode(by_path).alias("key")).distinct(), "keys")
    host_keys = staged(places.select("host").distinct().select(F.explode(by_name).alias("key")).distinct(), "hosts")
    by_rule = build_cascades(table(rules), rule_keys, max_level_bits=max_level_bits)
    # Whether a rule blocks is asked of rules alone, so they are the whole universe there.
    blocking = build_cascades(table(sorted(set(block))), table(rules), max_level_bits=max_level_bits)
    by_host = build_cascades(table(sorted(set(blocked_hosts))), host_keys, max_level_bits=max_level_bits)
    judged = with_listed(judged, "__rules", by_path, by_rule)
    longest = F.array_max(F.transform("__rules", lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    judged = with_listed(judged.withColumn("rule", longest), "__hosts", by_name, by_host)
    judged = with_listed(judged, "__blocking", F.when(F.col("rule").isNotNull(), F.array("rule")).otherwise(F.array().cast("array<string>")), blocking)
    judged = judged.withColumn("listed", F.size("__hosts") > 0)
    verdict = F.when(F.size("__blocking") > 0, "block").when(F.col("rule").isNotNull(), "allow").when(F.col("listed"), "block").otherwise("allow")
    return judged.withColumn("verdict", verdict).drop("__rules", "__hosts", "__blocking")
