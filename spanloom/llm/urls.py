"""URL filter over a sorted digest array.

The rules' keys (host + path prefix) are hashed to 64 bits and sorted; workers map the array into
memory and probe it with vectorised binary search. A hit counts only if the stored full string
equals the probed one, so collisions of digests do no harm. A url is probed with each of its host
suffixes and path prefixes that have a length occurring among the rules.

The array is broadcast only while the rules number at most ``MAX_INDEX_RULES``; beyond that the
same candidates are joined with the rules by a shuffle, with the same result.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule. Hosts
are lower-cased in A-Z only; ports and user names stay part of the host. The path of
``http://a.net`` is empty, so a rule with a path does not fit it. Longest rule wins, then the one
with the longer host. Repeated rules count once; a rule both allowed and blocked is blocked.
Without a rule the verdict is ``default`` (allow).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import ascii_lower, read, tune

#: Keys of at most a few dozen bytes: an index of at most about 100 MB.
MAX_INDEX_RULES = 1_000_000
#: (verdict, host, path) of the production list, as the contract gives them.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


class DigestIndex:
    """Sorted 64-bit digests with their strings; the digests lie in a memory-mapped file."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        import numpy as np
        import xxhash

        best: dict[str, tuple[str, int]] = {}
        for verdict, host, path in rules:
            key = host + path
            if key not in best or verdict == "block":
                best[key] = (verdict, len(host))
        entries = sorted((xxhash.xxh64_intdigest(k), k, v, h) for k, (v, h) in best.items())
        self.strings = [e[1] for e in entries]
        self.verdicts = [e[2] for e in entries]
        self.hosts = [e[3] for e in entries]
        self.digests = np.array([e[0] for e in entries], np.uint64)
        self.labels = sorted({k[:h].count(".") + 1 for k, (_, h) in best.items()})
        self.paths = sorted({len(k) - h for k, (_, h) in best.items()})

    def __getstate__(self):
        state = self.__dict__.copy()
        state["digests"] = self.digests.tobytes()
        return state

    def __setstate__(self, state):
        import numpy as np

        raw = state.pop("digests")
        self.__dict__ |= state
        if raw:
            self._file = tempfile.TemporaryFile()
            self._file.write(raw)
            self._file.flush()
            self.digests = np.memmap(self._file, np.uint64, "r")
        else:
            self.digests = np.empty(0, np.uint64)

    def candidates(self, host: str, path: str) -> list[str]:
        if not host:
            return []
        labels = host.split(".")
        suffixes = [".".join(labels[-n:]) for n in self.labels if n <= len(labels)]
        prefixes = [path[:n] for n in self.paths if n <= len(path)]
        return [s + p for s in suffixes for p in prefixes]

    def match(self, hosts: list[str], paths: list[str]) -> list[int]:
        """For each url the place of its winning rule, or -1."""
        import numpy as np
        import xxhash

        keys, owner = [], []
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            c = self.candidates(h, p)
            keys += c
            owner += [i] * len(c)
        won = [-1] * len(hosts)
        if not keys or not len(self.digests):
            return won
        probes = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, probes)
        hit = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == probes))
        for j in hit:
            k, key = int(at[j]), keys[j]
            while k < len(self.strings) and self.digests[k] == probes[j]:
                if self.strings[k] == key:
                    i = owner[j]
                    w = won[i]
                    if w < 0 or (len(key), self.hosts[k]) > (len(self.strings[w]), self.hosts[w]):
                        won[i] = k
                    break
                k += 1
        return won


def parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    pattern = "^[\\s\\S]*?://([^/?#]*)([^?#]*)"
    return df.withColumn("host", ascii_lower(F.regexp_extract(url, pattern, 1))).withColumn("path", F.regexp_extract(url, pattern, 2))


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_index_rules: int = MAX_INDEX_RULES) -> DataFrame:
    """(id, host, path, rule, verdict) for every row. ``rules``: (verdict, host, path) rows."""
    urls = parts(df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url").drop("url")
    spark = df.sparkSession
    if isinstance(rules, DataFrame):
        if rules.limit(max_index_rules + 1).count() > max_index_rules:
            return _by_join(urls, rules, default).withColumnRenamed("id", id_col)
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    elif len(rules) > max_index_rules:
        frame = spark.createDataFrame(rules, "verdict string, host string, path string")
        return _by_join(urls, frame, default).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(DigestIndex(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            won = index.match(hosts, paths)
            yield pa.record_batch(
                [*b.columns, pa.array([index.strings[w] if w >= 0 else None for w in won], pa.string()), pa.array([index.verdicts[w] if w >= 0 else default for w in won], pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    kind = urls.schema["id"].dataType.simpleString()
    return urls.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rule lists too large to send to every worker."""
    keyed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    keyed = keyed.select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("rule_host"))
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    labels = [r[0] for r in rules.select(F.size(F.split("host", "\\."))).distinct().collect()]
    urls = urls.withColumn("uid", F.monotonically_increasing_id())
    label = F.split("host", "\\.")
    suffix = F.array(*[F.when(F.size(label) >= n, F.array_join(F.slice(label, F.size(label) - n + 1, n), ".")) for n in labels])
    prefix = F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths])
    probes = urls.filter("host <> ''").select("uid", F.explode(F.array_compact(suffix)).alias("s"), F.array_compact(prefix).alias("ps"))
    probes = probes.select("uid", "s", F.explode("ps").alias("p")).select("uid", F.concat("s", "p").alias("rule"))
    best = probes.join(keyed, "rule").groupBy("uid").agg(F.max(F.struct(F.length("rule").alias("n"), "rule_host", "rule", "verdict")).alias("b"))
    return urls.join(best, "uid", "left").select("id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return filter_urls(read(spark, sf_dir, "pages"), RULES)


SQL = {
    "op2_url_filter": """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS n
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
}
