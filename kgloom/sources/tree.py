"""A folder of sources as a data source: a partition for each of its upper folders, ignore rules of every folder on the way.

``spark.read.format("source_tree").load(uri)`` gives file (relative path) and content, null where it cannot be read; ``readStream`` gives file
and stamp (size and time of change) of the whole tree at each trigger.  The tree may be on any file system that Arrow opens by its URI and that
executors reach too.  Left out are hidden and ignored names, folders of builds, other languages and files over ``MAX_FILE`` bytes.

Ignore rules are those of ``.gitignore`` and ``.ignore``: in each folder they hold for what is below it, rules of deeper folders come
first, in a file the last match counts, ``!`` takes back, a slash within anchors to the folder, one at the end means folders, ``**`` any depth.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MAX_FILE = 10 * 1024 * 1024
SKIPPED_DIRS = {"target", "node_modules", ".git", "dist", "build"}
_RULES = (".gitignore", ".ignore")
_BATCH_BYTES = 4 << 20

#: Language by file extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "rb": "ruby", "php": "php",
}


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def _pattern(glob: str) -> str:
    """A glob of ignore rules as a regular expression over a path below its folder."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def rules_of(text: str) -> list[tuple[bool, bool, str]]:
    """(taken back, folders only, pattern) of each line."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        body = line[1:] if back else line
        folders = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        out.append((back, folders, ("" if anchored else "(?:.*/)?") + _pattern(body.lstrip("/"))))
    return out


def ignored(rel: str, is_dir: bool, stack: list[tuple[str, list[tuple[bool, bool, str]]]]) -> bool:
    """Whether the rules of the folders on the way (folder, rules), root first, leave a path out."""
    for folder, rules in reversed(stack):
        below = rel[len(folder) + 1 :] if folder else rel
        for back, folders, pattern in reversed(rules):
            if (is_dir or not folders) and re.fullmatch(pattern, below):
                return not back
    return False


def _children(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    return sorted(fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)), key=lambda x: x.base_name)


def _stacked(fs: pafs.FileSystem, rel: str, children: list[pafs.FileInfo], stack: list) -> list:
    for name in _RULES:
        for x in children:
            if x.base_name == name and x.is_file:
                with fs.open_input_stream(x.path) as f:
                    stack = [*stack, (rel, rules_of(f.read().decode("utf-8", "replace")))]
    return stack


def _inside(rel: str, name: str) -> str:
    return f"{rel}/{name}" if rel else name


def split(fs: pafs.FileSystem, path: str, rel: str, stack: list) -> tuple[list[pafs.FileInfo], list[tuple[str, str, list]]]:
    """Files of a folder that are kept, and its folders (path, relative path, rules on the way)."""
    children = _children(fs, path)
    stack = _stacked(fs, rel, children, stack)
    files, folders = [], []
    for x in children:
        own = _inside(rel, x.base_name)
        is_dir = x.type == pafs.FileType.Directory
        if x.base_name.startswith(".") or ignored(own, is_dir, stack):
            continue
        if is_dir and x.base_name not in SKIPPED_DIRS:
            folders.append((x.path, own, stack))
        elif x.is_file and language_of(x.base_name) and x.size <= MAX_FILE:
            files.append(x)
    return files, folders


def walk(fs: pafs.FileSystem, path: str, rel: str, stack: list, deep: bool = True) -> Iterator[tuple[str, pafs.FileInfo]]:
    """(relative path, file) of a folder, and of all below it if ``deep``."""
    files, folders = split(fs, path, rel, stack)
    for x in files:
        yield _inside(rel, x.base_name), x
    for folder in folders if deep else ():
        yield from walk(fs, *folder)


class _Folder(InputPartition):
    def __init__(self, path: str, rel: str, stack: list, deep: bool) -> None:
        self.path, self.rel, self.stack, self.deep = path, rel, stack, deep


class _Tree:
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]

    def open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pafs.LocalFileSystem(), self.uri)

    def folders(self) -> list[InputPartition]:
        """Two levels of folders, the files beside them apart: only these are listed here."""
        fs, root = self.open()
        out: list[InputPartition] = [_Folder(root, "", [], False)]
        for path, rel, stack in split(fs, root, "", [])[1]:
            out.append(_Folder(path, rel, stack, False))
            out += [_Folder(*x, True) for x in split(fs, path, rel, stack)[1]]
        return out


class _Reader(_Tree, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.folders()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = self.open()
        names, bodies, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["file", "content"])

        for rel, x in walk(fs, partition.path, partition.rel, partition.stack, partition.deep):
            try:
                with fs.open_input_stream(x.path) as f:
                    body = f.read()
            except OSError:
                body = None
            names.append(rel)
            bodies.append(body)
            size += x.size or 0
            if size > _BATCH_BYTES:
                yield out()
                names, bodies, size = [], [], 0
        if names:
            yield out()


class _Listing(_Tree, DataSourceStreamReader):
    """The offset is the time of asking, so each trigger lists the tree."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.folders()

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        fs, _ = self.open()
        for rel, x in walk(fs, partition.path, partition.rel, partition.stack, partition.deep):
            yield rel, f"{x.size}-{x.mtime_ns}"

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file string, stamp string" if self.options.get("listing") == "true" else "file string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Listing(self.options)


def read_tree(spark: SparkSession, uri: str) -> DataFrame:
    """file, content of the sources below a folder."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").load(uri)


def watch_tree(spark: SparkSession, uri: str) -> DataFrame:
    """A stream of file, stamp: all sources below a folder at each trigger."""
    spark.dataSource.register(SourceTree)
    return spark.readStream.format("source_tree").option("listing", "true").load(uri)
