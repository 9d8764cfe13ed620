"""File trees as a corpus: a Python data source "quern_files".

    spark.dataSource.register(FileTree)
    spark.read.format("quern_files").option("path", root).load()

Options: path; max_filesize (10485760); follow (false); partitions (the default parallelism at most).
The driver lists the tree and the executors read the files, so the tree must be at the same path for
all. Regular files only; hidden names are skipped; .gitignore and .qignore are followed, the nearest
rule first, and of one folder's files .qignore first. Unreadable files give no row. With content=false
files are listed, not read. A name that isn't UTF-8 shows its stray bytes as \\xNN, and real() finds the file again.
"""

from __future__ import annotations

import os
import re
import stat
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions.glob import Ignore

MAX_FILESIZE = 10_485_760
IGNORE_FILES = (".qignore", ".gitignore")
LISTING = "file_path string, size long, mtime long"
SCHEMA = f"{LISTING}, content binary"


def shown(path: str) -> str:
    """A path as valid text."""
    return os.fsencode(path).decode("utf-8", "backslashreplace")


def real(path: str) -> bytes:
    """The path that shown() was given, in bytes."""
    raw = path.encode()
    if b"\\x" not in raw or os.path.exists(raw):
        return raw
    return re.sub(rb"\\x([89a-f][0-9a-f])", lambda m: bytes([int(m[1], 16)]), raw)


def head(root: str) -> str | None:
    """The commit that a tree is at, or None where it is in no repository."""
    try:
        got = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return None
    return got.stdout.strip() if got.returncode == 0 else None


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    mtime: int


def walk(root: str, max_filesize: int = MAX_FILESIZE, follow: bool = False) -> list[Found]:
    """The files of a tree, sorted by path."""
    out: list[Found] = []

    def ignored(rel: str, folder: bool, rules: list[tuple[str, Ignore]]) -> bool:
        for base, r in rules:
            said = r.verdict(rel[len(base) :], folder)
            if said is not None:
                return said
        return False

    def visit(folder: str, rel: str, rules: list[tuple[str, Ignore]], above: tuple) -> None:
        with os.scandir(folder) as it:
            entries = sorted(it, key=lambda e: e.name)
        own = []
        for name in IGNORE_FILES:
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    own.append((rel, Ignore(f.read())))
            except OSError:
                continue
        rules = own + rules
        for e in entries:
            if e.name.startswith("."):
                continue
            try:
                s = e.stat(follow_symlinks=follow)
            except OSError:
                continue
            path, inner = os.path.join(folder, e.name), f"{rel}{e.name}"
            is_dir = stat.S_ISDIR(s.st_mode)
            if ignored(inner, is_dir, rules):
                continue
            if is_dir:
                key = (s.st_dev, s.st_ino)
                if key not in above:  # else a link leads back to a folder it lies in
                    visit(path, inner + "/", rules, (*above, key))
            elif stat.S_ISREG(s.st_mode) and s.st_size <= max_filesize:
                out.append(Found(path, s.st_size, int(s.st_mtime)))

    top = os.stat(root)
    visit(os.path.abspath(root), "", [], ((top.st_dev, top.st_ino),))
    return sorted(out, key=lambda f: f.path)


@dataclass
class _Part(InputPartition):
    files: tuple[Found, ...]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.limit = int(options.get("max_filesize", MAX_FILESIZE))
        self.follow = str(options.get("follow", "false")).lower() == "true"
        self.parts = int(options.get("partitions", 0)) or 64
        self.content = str(options.get("content", "true")).lower() == "true"

    def partitions(self):
        files = walk(self.root, self.limit, self.follow)
        total = sum(f.size for f in files) or 1
        share, parts, own, size = total / self.parts, [], [], 0
        for f in files:
            own.append(f)
            size += f.size
            if size >= share:
                parts.append(_Part(tuple(own)))
                own, size = [], 0
        return [*parts, _Part(tuple(own))] if own or not parts else parts

    def read(self, partition) -> Iterator[tuple]:
        for f in partition.files:
            if not self.content:
                yield shown(f.path), f.size, f.mtime
                continue
            try:
                with open(f.path, "rb") as h:
                    content = h.read()
            except OSError:
                continue
            yield shown(f.path), len(content), f.mtime, content


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_files"

    def schema(self) -> str:
        return SCHEMA if str(self.options.get("content", "true")).lower() == "true" else LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark, root: str, **options):
    """The corpus of a file tree."""
    spark.dataSource.register(FileTree)
    return spark.read.format("quern_files").options(path=root, **options).load()


def listing(spark, root: str, **options) -> DataFrame:
    """(file_path, size, mtime) of a tree's files, none of which is opened."""
    return read(spark, root, **options, content="false")


def fetch(paths: DataFrame, max_filesize: int = MAX_FILESIZE) -> DataFrame:
    """The corpus rows of the files that (file_path, ...) names: the executors open these and no others."""

    def run(batches):
        for b in batches:
            rows = []
            size = 0
            for path in b.column(0).to_pylist():
                try:
                    own = real(path)
                    s = os.stat(own)
                    if not stat.S_ISREG(s.st_mode) or s.st_size > max_filesize:
                        continue
                    with open(own, "rb") as h:
                        content = h.read()
                except OSError:
                    continue
                rows.append((path, len(content), int(s.st_mtime), content))
                size += len(content)
                if size > 32 << 20:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    def made(rows):
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["file_path", "size", "mtime", "content"])

    return paths.select("file_path").mapInArrow(run, SCHEMA)


#: What a fresh ignore file leaves out, by a file that tells the kind of project.
_PROJECTS = {
    "package.json": ("node_modules/", "dist/", ".next/", "coverage/"), "Cargo.toml": ("target/",), "go.mod": ("vendor/",), "requirements.txt": ("__pycache__/", "*.pyc", "venv/"),
    "pyproject.toml": ("__pycache__/", "*.pyc", "venv/"), "Gemfile": ("vendor/bundle/",), "pom.xml": ("target/",), "build.gradle": ("build/",),
}


def initialise(root: str, hook: str | None = None) -> list[str]:
    """Sets a tree up: an ignore file that suits its projects, unless it has one, and, where `hook` is a shell command,
    a post-commit hook that runs it (in a repository only). The paths that were written."""
    wrote = []
    path = os.path.join(root, IGNORE_FILES[0])
    if not os.path.exists(path):
        rules = dict.fromkeys(r for mark, own in _PROJECTS.items() if os.path.exists(os.path.join(root, mark)) for r in own)
        with open(path, "w") as f:
            f.write("".join(f"{r}\n" for r in ("# left out of the index", *rules)))
        wrote.append(path)
    hooks = os.path.join(root, ".git", "hooks")
    if hook and os.path.isdir(hooks):
        path = os.path.join(hooks, "post-commit")
        with open(path, "w") as f:
            f.write(f"#!/bin/sh\n{hook} &\n")
        os.chmod(path, 0o755)
        wrote.append(path)
    return wrote


def arguments(path: str | None = None) -> list[str]:
    """Default arguments from a file: one a line, # comments and blank lines left out. The path is that of
    QUERN_CONFIG_PATH where none is given; a missing file has none."""
    path = path or os.environ.get("QUERN_CONFIG_PATH")
    if not path or not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [x for x in map(str.strip, f) if x and not x.startswith("#")]


def options_from(arguments_: list[str]) -> dict:
    """Search options from such arguments, e.g. --smart-case, --glob=*.py, --max-count 3."""
    names = {"-i": "ignore_case", "--ignore-case": "ignore_case", "-S": "smart_case", "--smart-case": "smart_case", "-F": "fixed", "--fixed-strings": "fixed"}
    values = {"-g": ("glob", str), "--glob": ("glob", str), "-t": ("file_type", str), "--type": ("file_type", str), "-m": ("max_count", int), "--max-count": ("max_count", int), "-C": ("context", int), "--context": ("context", int)}
    out: dict = {}
    rest = iter(arguments_)
    for a in rest:
        key, eq, value = a.partition("=")
        if key in names:
            out[names[key]] = True
        elif key in values:
            name, kind = values[key]
            out[name] = kind(value if eq else next(rest))
        else:
            raise ValueError(f"unknown argument {a!r}")
    return out
