"""URL rules by Bloom filter cascades over the corpus's whole universe of keys.

A key is a host or one of its parent domains, followed by the beginning of the path in one of the lengths that rules have. Level 0
of a cascade holds the listed keys, level 1 the corpus's other keys that level 0 takes for listed, level 2 the listed keys that
level 1 takes, and so on until no error is left. For every key of the corpus, membership is then exact, without a join with a list
or a table of URLs. The first level's rate of errors follows the ratio of listed to all keys, so that all further levels together
stay about as large as the list, which is a parameter and held by the driver already.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, small_batches

Rule = tuple[str, str, str]  # allow or block, host, path

#: The production rules.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


class Bloom:
    """Bits for n keys at a rate of at most p of errors: probes and bits are added until the fill gives that rate, as each probe has
    hash bits of its own. salt differs from level to level."""

    def __init__(self, keys, n: int, p: float, salt: int):
        self.turns, self.salt = 1, salt
        self.width = max(10, math.ceil(math.log2(max(1.0, -n * math.log(p) / math.log(2) ** 2))))
        while (1 - math.exp(-self.turns * n / 2**self.width)) ** self.turns > p and self.turns < -2 * math.log2(p):
            self.turns += 1
        while True:
            bits = np.zeros(1 << self.width, bool)
            for key in keys:
                bits[list(self._places(key))] = True
            if bits.mean() ** self.turns <= p:
                break
            self.turns, self.width = (self.turns + 1, self.width) if bits.mean() < 0.4 else (self.turns, self.width + 1)
        self.bits = np.packbits(bits).tobytes()

    def _places(self, key: str):
        each, mask = 128 // self.width, (1 << self.width) - 1
        for turn in range(self.turns):
            if turn % each == 0:
                both = xxhash.xxh3_128_intdigest(key, seed=self.salt << 32 | turn)
            yield both & mask
            both >>= self.width

    def __contains__(self, key: str) -> bool:
        return all(self.bits[k >> 3] & 128 >> (k & 7) for k in self._places(key))


class Cascade:
    def __init__(self):
        self.levels: list[Bloom] = []

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def build(listed: set[str], universe: DataFrame, count: int) -> Cascade:
    """listed: keys on the list. universe(key): all distinct keys of the corpus, `count` of them. Tasks get level 0 alone and return the
    keys that it takes; the driver, which has the list, leaves the listed ones out, about 0.7 wrong ones for each listed key. A level 0
    that takes far more is made anew with the square of its rate. An empty list or universe needs no further level."""
    made = Cascade()
    if not listed:
        return made
    p, bound, salt = min(0.5, len(listed) / (math.sqrt(2) * max(count, 1))), 20 * len(listed) + 1000, 0
    while True:
        first = Bloom(sorted(listed), len(listed), p, salt)
        taken = [row.key for row in universe.mapInArrow(_taken(first), "key string").take(bound + len(listed) + 1)]
        if len(taken) <= bound + len(listed):
            break
        p, salt = p * p, salt + 1
    made.levels.append(first)
    inside, outside = set(listed), set(taken) - listed
    while outside:
        made.levels.append(Bloom(sorted(outside), len(outside), 0.5, salt + len(made.levels)))
        inside, outside = outside, {k for k in inside if k in made.levels[-1]}
    return made


def _taken(level: Bloom):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k in batch.column("key").to_pylist() if k in level], pa.string())})

    return run


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a text without `://`; A-Z of the host is lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """The keys of a URL from the longest on; of equally long ones, that with the longer host first."""
    if not host:
        return []
    hosts, found = [host], []
    while "." in hosts[-1]:
        hosts.append(hosts[-1].partition(".")[2])
    for h in hosts:
        found += [(len(h) + n, len(h), h + path[:n]) for n in lengths if len(path) >= n]
    return [k for _, _, k in sorted(found, reverse=True)]


def _key_batches(lengths: list[int]):
    def run(batches):
        for batch in batches:
            pairs = set(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict({"key": pa.array(sorted({k for h, p in pairs for k in keys_of(h, p, lengths)}), pa.string())})

    return run


def _verdict_batches(lengths: list[int], allow: Cascade, block: Cascade, default: str):
    def run(batches):
        for batch in batches:
            rules, verdicts = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                rule, verdict = None, default
                for key in keys_of(host, path, lengths):
                    if key in block:
                        rule, verdict = key, "block"
                        break
                    if key in allow:
                        rule, verdict = key, "allow"
                        break
                rules.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """pages(page_id, url, ...) -> page_id, host, path, rule, verdict: one row for each input row.

    A rule fits its host and all subdomains if the path starts with its path; the longest wins, block before allow for one key.
    Without a rule: rule null, verdict `default`. Null, empty and odd URLs have an empty host and fit no rule. Repeated rows are
    judged alike, other columns are not read, very long URLs are read whole. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    scratch = Scratch(spark, "urls")
    universe = scratch.keep(rows.select("host", "path").mapInArrow(_key_batches(lengths), "key string").distinct(), "universe")
    count = universe.count()
    block = build({h + p for v, h, p in rules if v == "block"}, universe, count)
    allow = build({h + p for v, h, p in rules if v == "allow"}, universe, count)
    return rows.mapInArrow(_verdict_batches(lengths, allow, block, default), "page_id long, host string, path string, rule string, verdict string")
