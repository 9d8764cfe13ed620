"""One object for a corpus and its index: build, update, status, search, replace, watch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators import index, replace, search
from quern.operators.search import SearchOptions
from quern.sources import corpus as files
from quern.sources.shared import shared


class Engine:
    """corpus: a DataFrame (file_path, content, perhaps mtime), or the path of a file tree."""

    def __init__(self, spark: SparkSession, corpus: DataFrame | str, index_root: str | None = None, **source):
        self.spark, self.source, self.index_root, self.options = spark, corpus, index_root, source

    @property
    def corpus(self) -> DataFrame:
        return files.read(self.spark, self.source, **self.options) if self.is_tree else self.source

    @property
    def is_tree(self) -> bool:
        return isinstance(self.source, str)

    def _fetch(self, paths: DataFrame) -> DataFrame:
        return files.fetch(paths, int(self.options.get("max_filesize", files.MAX_FILESIZE)))

    def init(self, hook: str | None = None) -> dict:
        """Writes an ignore file (and a hook) where there is none, and builds the index."""
        if self.is_tree:
            files.initialise(self.source, hook)
        return self.build()

    def build(self, commit: str | None = None) -> dict:
        """commit: by default that of the tree's repository."""
        return index.build(self.corpus, self.index_root, commit or (files.head(self.source) if self.is_tree else None))

    def update(self) -> dict:
        """Of a tree only files whose size or time differs are read."""
        if not self.is_tree:
            return index.update(self.corpus, self.index_root)
        return index.update(self.corpus, self.index_root, files.listing(self.spark, self.source, **self.options), self._fetch, files.head(self.source))

    def status(self) -> DataFrame:
        return index.status(self.spark, self.index_root)

    def search(self, pattern: str | list[str], options: SearchOptions | None = None, auto_index: bool = False) -> DataFrame:
        """By the index where there is one; of a tree only the candidates are read."""
        if self.index_root and (auto_index or index.current(self.index_root, self.spark)):
            return index.search(self.corpus, self.index_root, pattern, options, auto_index, self._fetch if self.is_tree else None)
        return search.search(self.corpus, pattern, options)

    def scan(self, pattern: str | list[str], options: SearchOptions | None = None) -> DataFrame:
        """Without the index."""
        return search.search(self.corpus, pattern, options)

    def preview(self, pattern: str, replacement: str, options: SearchOptions | None = None) -> DataFrame:
        return replace.preview(self.corpus, pattern, replacement, options)

    def replace(self, pattern: str, replacement: str, options: SearchOptions | None = None) -> int:
        """Writes changed files back; how many."""
        if not self.is_tree:
            raise TypeError("only the files of a tree are written back; use operators.replace.apply on a DataFrame")
        return replace.write_tree(replace.replaced(self.corpus, pattern, replacement, options), shared(self.spark, "replaced"))

    def watch(self, **kw):
        from quern.streaming.watch import watch

        return watch(self.spark, self, **kw)
