"""A cache of results by key that grows by small writes and stays quick to read.

Rows lie in buckets by a hash of their key. An upsert adds a run: a folder with files, sorted
by key, for the buckets that its keys fall into, and nothing else is read or written. A
bucket of several runs is merged when it is read, the later run's row being the one that
counts, and after `most_runs` it is written anew as one run (only such buckets are). A run
counts from the moment that its marker is there, which is written last and in one step, so
a writer that dies leaves the cache as it was. There is one writer at a time; a reader may go
on over one compaction, as files go at the next one only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import last_wins
from .files import checkpointed, delete, names, read_json, write_json


class KeyedCache:
    """path: a folder on any store that Spark reads; keys: the columns of a key, none of them null."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, most_runs: int = 4):
        self.spark, self.path, self.keys, self.most_runs = spark, path.rstrip("/"), keys, most_runs
        told = read_json(f"{self.path}/cache.json")
        if told is None:
            told = {"keys": keys, "buckets": buckets}
            write_json(f"{self.path}/cache.json", told)
        if told["keys"] != keys:
            raise ValueError(f"this cache has the keys {told['keys']}")
        self.buckets = told["buckets"]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def runs(self) -> list[dict]:
        """What the markers say, oldest first: number, buckets, whether the run replaces what its buckets had."""
        found = sorted(int(n.removesuffix(".json")) for n in names(f"{self.path}/runs") if n.endswith(".json"))
        return [{"run": n, **read_json(f"{self.path}/runs/{n}.json")} for n in found]

    def live(self) -> dict[int, list[int]]:
        """The runs that count, by bucket, oldest first."""
        out: dict[int, list[int]] = {}
        for r in self.runs():
            for b in r["buckets"]:
                out[b] = [r["run"]] if r["full"] else [*out.get(b, []), r["run"]]
        return out

    def _write(self, rows: DataFrame, full: bool) -> list[int]:
        known = self.runs()
        n = known[-1]["run"] + 1 if known else 0
        folder = f"{self.path}/data/run={n}"
        delete(folder)  # of a writer that died
        rows = rows.withColumn("bucket", self.bucket())
        rows.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(folder)
        own = sorted(int(x.split("=")[1]) for x in names(folder) if x.startswith("bucket="))
        if own:
            write_json(f"{self.path}/runs/{n}.json", {"full": full, "buckets": own})
        return own

    def _read(self, where: list[tuple[int, int]]) -> DataFrame:
        """Rows of (run, bucket) pairs with __run."""
        paths = [f"{self.path}/data/run={r}/bucket={b}" for r, b in where]
        rows = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(*paths)
        return rows.withColumnRenamed("run", "__run").drop("bucket")

    def load(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The last row of each key, of all keys or of the buckets that `keys` fall into; None of an empty cache."""
        live = self.live()
        if keys is not None:
            wanted = {r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # one for each bucket
            live = {b: runs for b, runs in live.items() if b in wanted}
        single = [(runs[0], b) for b, runs in live.items() if len(runs) == 1]
        several = [(r, b) for b, runs in live.items() if len(runs) > 1 for r in runs]
        parts = []
        if single:  # keys are unique within a run
            parts.append(self._read(single).drop("__run"))
        if several:
            parts.append(last_wins(self._read(several), self.keys, ["__run"]).drop("__run"))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def pending(self, records: DataFrame) -> DataFrame:
        """Records whose key the cache lacks; buckets that they don't fall into aren't read."""
        have = self.load(records)
        return records if have is None else records.join(have.select(*self.keys), self.keys, "left_anti")

    def upsert(self, new: DataFrame, order: list[str] | None = None) -> list[int]:
        """Add rows or put them in place of those of equal key; of equal keys in `new` the last by `order`. Returns the buckets written.

        Buckets that then have more than `most_runs` runs are compacted.
        """
        if order:
            new = last_wins(new, self.keys, order)
        else:
            new = new.dropDuplicates(self.keys)
        own = self._write(new, False)
        crowded = [b for b, runs in self.live().items() if len(runs) > self.most_runs]
        if crowded:
            self.compact(crowded)
        return own

    def compact(self, buckets: list[int] | None = None) -> None:
        """Write the given buckets (all of several runs, if none are named) as one run each; what an earlier compaction replaced is deleted."""
        live, known = self.live(), self.runs()
        chosen = [b for b in (live if buckets is None else buckets) if len(live.get(b, [])) > 1]
        # what was replaced before: a run's bucket that a full run followed
        later: dict[int, int] = {}
        for r in known:
            if r["full"]:
                later.update({b: r["run"] for b in r["buckets"]})
        for r in known:
            for b in r["buckets"]:
                if r["run"] < later.get(b, -1):
                    delete(f"{self.path}/data/run={r['run']}/bucket={b}")
            if all(r["run"] < later.get(b, -1) for b in r["buckets"]):
                delete(f"{self.path}/runs/{r['run']}.json")
                delete(f"{self.path}/data/run={r['run']}")
        if chosen:
            rows = last_wins(self._read([(r, b) for b in chosen for r in live[b]]), self.keys, ["__run"]).drop("__run")
            self._write(checkpointed(rows), True)
