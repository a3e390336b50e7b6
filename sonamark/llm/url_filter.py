"""URL filters: allow and block entries in a trie over reversed host labels and then path segments; the longest entry that fits a url decides.

An entry is a host, a slash and the beginning of a path (`example.net/en/`). It fits the urls of its host and of all subdomains whose path begins with
the entry's path. The trie's first levels are host labels from the right, then come path segments with the slash behind them; what an entry says of
a segment that it doesn't finish (`a.b/en`) stands at the node before it, under its length. A url walks down once, so its cost is its own length
whatever the number of entries. The trie is broadcast if the entries are few enough (MOST_ENTRIES, MOST_BYTES, both counted first). More entries than that
are joined: a url asks for each suffix of its host and each beginning of its path by salted equi-joins, and an aggregate finds the longest entry.

Host: after the first `://` up to `/`, `?` or `#`, with A-Z lower-cased; ports and user names are part of it. Path: from there up to `?` or `#`. A null url or one without
`://` has neither, and no entry fits it. A url that no entry fits gets the verdict `allow`: the entries are exceptions from letting through. Of two entries of
one host and path that contradict each other, block wins; entries that repeat are one. An entry without a slash fits all paths, the empty one too. A null entry is left out. Null
page ids and repeated rows are judged row by row; a very long url is only split as far as the trie is deep. Empty tables give empty results. Other columns are not read,
so their names can't clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, discard, lower_ascii, split_join, written

#: Entries, and characters of them, up to which the trie is broadcast: about 500 MB in a Python worker.
MOST_ENTRIES, MOST_BYTES = 1_000_000, 50_000_000
DEFAULT = "allow"

#: The entries of the query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def parts(entries: DataFrame) -> DataFrame:
    """(host, path, rule, block) of entries (verdict, rule), one for each host and path."""
    at = F.locate("/", F.col("rule"))
    whole = entries.where("rule is not null and verdict in ('allow', 'block')")
    split = whole.select(lower_ascii(F.when(at > 0, F.substring("rule", F.lit(1), at - 1)).otherwise(F.col("rule"))).alias("host"), F.when(at > 0, F.substring("rule", at, F.length("rule"))).otherwise("").alias("path"), "rule", (F.col("verdict") == "block").alias("block"))
    best = split.groupBy("host", "path").agg(F.max(F.struct("block", "rule")).alias("b"))
    return best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.block").alias("block"))


class Trie:
    """Nodes are dicts of label or segment -> node; HERE holds the entry that ends at a node, BEGUN those that end within the next segment, PATH the node of the
    empty path of a host."""

    HERE, BEGUN, PATH = 0, 1, 2  # labels are strings, so these can't clash

    def __init__(self, entries: list[tuple[str, str, str, bool]]):
        self.root: dict = {}
        self.labels = self.segments = 0
        for host, path, rule, block in entries:
            node, names = self.root, host.split(".")
            self.labels = max(self.labels, len(names))
            for name in reversed(names):
                node = node.setdefault(name, {})
            node = node.setdefault(self.PATH, {})
            *whole, rest = path.split("/")
            self.segments = max(self.segments, len(whole))
            for segment in whole:
                node = node.setdefault(segment, {})
            if rest:
                node.setdefault(self.BEGUN, {}).setdefault(len(rest), {})[rest] = (rule, block)
            else:
                node[self.HERE] = (rule, block)

    @staticmethod
    def begun(node: dict, segment: str) -> tuple[str, bool] | None:
        """The entry with the longest unfinished segment that this one begins with."""
        lengths = node.get(Trie.BEGUN, {})
        for n in sorted(lengths, reverse=True):
            if found := lengths[n].get(segment[:n]):
                return found
        return None

    def fits(self, host: str, path: str) -> tuple[str, bool] | None:
        """The entry with the longest host, and of these with the longest path, as long as one of them fits."""
        node, hosts = self.root, []
        for name in reversed(host.rsplit(".", self.labels)[-self.labels :] if self.labels else []):
            node = node.get(name)
            if node is None:
                break
            if self.PATH in node:
                hosts.append(node[self.PATH])
        if not hosts:
            return None
        segments = path.split("/", self.segments + 1)
        for node in reversed(hosts):
            found = node.get(self.HERE)
            for k, segment in enumerate(segments):
                found = self.begun(node, segment) or found
                if k == len(segments) - 1 or (node := node.get(segment)) is None:
                    break
                found = node.get(self.HERE, found)
            if found:
                return found
        return None


def by_trie(urls: DataFrame, trie: Trie, schema: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(trie)

    def run(batches):
        fits = shared.value.fits
        for batch in batches:
            found = [fits(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([DEFAULT if f is None else "block" if f[1] else "allow" for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    arrow_rows(urls.sparkSession, 4096)
    return urls.mapInArrow(run, schema)


def by_join(urls: DataFrame, entries: DataFrame, labels: int, slashes: int) -> DataFrame:
    """The same for entries too many to broadcast, by two equi-joins. A url asks for each suffix of its host, of up to as many labels as an entry has, with each
    beginning of its path that ends with a slash, up to as many as an entry has, and learns how long the unfinished segments are that entries have there; then it asks for these lengths. No entries are gathered in a list."""
    pages = written(urls.withColumn("uid", F.monotonically_increasing_id()), "urls")
    table = entries.withColumns({"key": F.concat("host", F.lit("/"), F.regexp_extract("path", r"(?s)^(.*/)?[^/]*$", 1)), "full": F.concat("host", F.lit("/"), "path"), "e": F.struct(F.length("host").alias("a"), F.length("path").alias("b"), "rule", "block")})
    table = written(table.select("key", "full", (F.length("full") - F.length("key")).alias("n"), "e"), "entries")
    names, segments = F.split(F.substring_index("host", ".", -labels), r"\."), F.split("path", "/", slashes + 1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    ends = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.aggregate(F.slice(segments, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x) + 1))
    asked = pages.select("uid", "path", F.explode(suffixes).alias("h"), ends.alias("ends")).select("uid", "path", "h", F.explode("ends").alias("n"))
    asked = written(asked.select("uid", F.concat("h", F.lit("/"), F.left("path", F.col("n"))).alias("key"), F.expr("substring(path, n + 1)").alias("rest")), "asked")
    lengths = written(table.groupBy("key").agg(F.collect_set("n").alias("lengths")), "lengths")
    longer = split_join(asked, lengths, "key", "uid").select("uid", "key", "rest", F.explode("lengths").alias("n")).where(F.length("rest") >= F.col("n"))
    longer = written(longer.select("uid", F.concat("key", F.left("rest", F.col("n"))).alias("full")), "longer")
    best = split_join(longer, table.select("full", "e"), "full", "uid").groupBy("uid").agg(F.max("e").alias("e"))
    out = written(pages.join(best, "uid", "left").select("page_id", "host", "path", F.col("e.rule").alias("rule"), F.when(F.col("e.block"), "block").when(~F.col("e.block"), "allow").otherwise(DEFAULT).alias("verdict")), "judged")
    discard(pages, table, asked, lengths, longer)
    return out


def judge_urls(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per input row: page_id, host, path, rule (null where none fits), verdict. entries: verdict (allow or block), rule."""
    own = parts(entries)
    depth = lambda c, mark: F.coalesce(F.max(F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))), F.lit(0))
    n, size, dots, slashes = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0)), depth("host", "."), depth("path", "/")).first()
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if n > most_entries or size > most_bytes:
        return by_join(urls, own, dots + 1, slashes)
    kind = urls.schema["page_id"].dataType.simpleString()
    return by_trie(urls, Trie([tuple(r) for r in own.collect()]), f"page_id {kind}, host string, path string, rule string, verdict string")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, rule string")
