"""A file tree's changes as a stream: "quern_changes" gives (file_path, change, size, mtime).

Each micro-batch compares the tree with the manifest that the last offset names, so created, rewritten and
deleted files all show. Manifests are kept as files in the option `state`; an offset is the number of
one, so that a batch can be read again after a failure. watch() updates an index from it. The tree and the
state lie at one path for the driver and the executors, as `quern_files` asks.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quern.sources.corpus import MAX_FILESIZE, shown, walk

SCHEMA = "file_path string, change string, size long, mtime long"


def difference(old: dict, new: dict) -> list[tuple]:
    """(path, change, size, mtime) by path; manifests are {path: [size, mtime in ns]}."""
    out = []
    for p in sorted(old.keys() | new.keys()):
        if p not in new:
            out.append((p, "deleted", *old[p]))
        elif old.get(p) != new[p]:
            out.append((p, "changed" if p in old else "added", *new[p]))
    return out


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.root, self.state = options["path"], options["state"]
        self.skip = os.path.abspath(options["skip"]) + os.sep if options.get("skip") else None
        self.limit, self.follow = int(options.get("max_filesize", MAX_FILESIZE)), str(options.get("follow", "false")).lower() == "true"
        os.makedirs(self.state, exist_ok=True)

    def _load(self, n: int) -> dict:
        if n == 0:
            return {}
        with open(f"{self.state}/{n}.json") as f:
            return json.load(f)

    def _scan(self) -> dict:
        out = {}
        for f in walk(self.root, self.limit, self.follow):
            if self.skip and f.path.startswith(self.skip):
                continue
            try:
                out[shown(f.path)] = [f.size, os.stat(f.path).st_mtime_ns]
            except OSError:
                continue
        return out

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n, new = start["n"], self._scan()
        rows = difference(self._load(n), new)
        if not rows:
            return iter(()), start
        part = f"{self.state}/{n + 1}.json.part"
        with open(part, "w") as f:
            json.dump(new, f)
        os.replace(part, f"{self.state}/{n + 1}.json")
        return iter(rows), {"n": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(difference(self._load(start["n"]), self._load(end["n"])))

    def commit(self, end: dict) -> None:
        for n in range(max(1, end["n"] - 8), end["n"] - 1):
            try:
                os.unlink(f"{self.state}/{n}.json")
            except FileNotFoundError:
                continue


class Changes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def changes(spark: SparkSession, root: str, state: str, skip: str | None = None, **options):
    """The streaming DataFrame of a tree's changes. options: max_filesize and follow, as for `quern_files`."""
    spark.dataSource.register(Changes)
    reader = spark.readStream.format("quern_changes").options(path=root, state=state, **options)
    return (reader.option("skip", skip) if skip else reader).load()


def watch(spark: SparkSession, engine, *, interval: str = "500 milliseconds", state: str | None = None, on_update: Callable[[dict], None] | None = None):
    """Starts a query that updates the engine's index after each batch of changes; stop() ends it. An update lists the
    tree and reads the files that differ; one that fails is logged, and the next batch makes up for it."""
    options = {k: v for k, v in engine.options.items() if k in ("max_filesize", "follow")}
    folder = state or engine.index_root.removeprefix("file://")

    def done(batch, _):
        if batch.isEmpty():
            return
        try:
            got = engine.update()
        except Exception:
            logging.getLogger("quern").exception("the index could not be updated")
            return
        if on_update:
            on_update(got)

    stream = changes(spark, engine.source, f"{folder}/watch", folder, **options)
    return stream.writeStream.trigger(processingTime=interval).option("checkpointLocation", f"{folder}/watch-checkpoint").foreachBatch(done).start()
