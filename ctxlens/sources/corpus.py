"""Source files of repositories and their embedding vectors."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlens.runtime import stage

NAMES_PER_TASK = 4096
BYTES_PER_TASK = 1 << 27
BYTES_PER_BATCH = 1 << 22


def _is_hidden(path: str) -> bool:
    """Whether Spark's file readers pass over a file; folders of metadata they enter."""

    def passed_over(name: str) -> bool:
        return (
            name.startswith(".")
            or (name.startswith("_") and "=" not in name)
            or name.endswith("._COPYING_")
        )

    *folders, file = path.split("/")
    entered = ("_metadata", "_common_metadata")
    return passed_over(file) or any(
        passed_over(f) and not f.startswith(entered) for f in folders
    )


def _arrow_uri(root: str) -> str:
    """The root as Arrow names it: s3a and s3n are s3, a bare path is a local file."""
    if "://" not in root:
        return "file:///" + re.sub("^(file:)?/+", "", root)
    return re.sub("^s3[an]://", "s3://", root)


_LISTED = "path string, is_folder boolean, size bigint, linked boolean"


def _listing(root: str, links: bool):
    """Task that lists folders (path, linked), each by itself: path, whether it is a folder, size, and linked.

    Folders behind local symbolic links are passed over, or with `links` marked as linked.
    """

    schema = pa.schema(
        [("path", pa.string()), ("is_folder", pa.bool_()), ("size", pa.int64()), ("linked", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            for folder, linked in zip(*(batch.column(c).to_pylist() for c in ("path", "linked")), strict=True):
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                behind = [not f.is_file and local and os.path.islink(f.path) for f in found]
                entered = [f.type == fs.FileType.Directory and links if b else True for f, b in zip(found, behind, strict=True)]
                kept = [(f, b) for f, b, e in zip(found, behind, entered, strict=True) if e]
                columns = (
                    [f.path[len(base) + 1 :] for f, _ in kept],
                    [not f.is_file for f, _ in kept],
                    [f.size if f.is_file else None for f, _ in kept],
                    [linked or b for _, b in kept],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )

    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below `root`, hidden names included, in any store that Arrow opens.

    The tree is listed level by level: the folders of one level are rows that are dealt over
    the tasks, and what they hold is written before the next level begins. A task holds
    the names of one folder.
    """
    return _listed(spark, root, links=False).select("path", "size")


def _listed(spark: SparkSession, root: str, links: bool) -> DataFrame:
    """(path, size, linked): see `list_files`; with `links` also the files behind linked folders."""
    uri = _arrow_uri(root.rstrip("/"))
    level, found = spark.createDataFrame([("", False)], "path string, linked boolean"), None
    while True:
        made = stage(level.mapInArrow(_listing(uri, links), _LISTED), "listing")
        files = made.where(~F.col("is_folder")).select("path", "size", "linked")
        found = files if found is None else found.union(files)
        folders = made.where("is_folder").select("path", "linked")
        if not (n := folders.count()):
            return found
        level = _dealt(folders, n)


def _dealt(names: DataFrame, n: int, size: int = 0) -> DataFrame:
    """`n` names, of files of `size` bytes in all, over as many tasks as they are worth; their own few bytes would make one task."""
    return names.repartition(max(-(-n // NAMES_PER_TASK), -(-size // BYTES_PER_TASK), 1), "path")


def _contents(root: str):
    """Task that reads files by their names."""

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            names, contents, held = [], [], 0
            for name in batch.column("path").to_pylist():
                # Bytes as they are: Arrow would take a name's ending for a compression.
                with store.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None) as f:
                    contents.append(f.read())
                names.append(name)
                held += len(contents[-1])
                if held >= BYTES_PER_BATCH:
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=schema)
                    names, contents, held = [], [], 0
            if names:
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=schema)

    return run


def read_code(
    spark: SparkSession, root: str, repo: str, glob: str = "*.py", hidden: bool = True
) -> DataFrame:
    """code_files(repo, path, module, content) of every matching file under `root`.

    Files are read as bytes and kept only if they are valid UTF-8. Spark's file
    readers keep the names of all files in the driver and pass over empty files and names that
    begin with `_` or `.`, among them every `__init__.py`; so files are found by `list_files` and
    read by tasks that are dealt their names. Without `hidden` only what Spark's readers see is
    read, by them, for stores that only Spark opens.
    """
    if hidden:
        files = _read_listed(spark, root, glob)
    else:
        base = re.sub("^(file:)?/+", "file:/", root.rstrip("/")) if "://" not in root else root.rstrip("/")
        base = re.sub("^file:/+", "file:/", base)
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .load(root)
            .select(
                F.replace(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(base + "/"), F.lit("")).alias("path"),
                "content",
            )
        )
    text = F.col("content").cast("string")
    return files.where(F.is_valid_utf8(text)).select(
        F.lit(repo).alias("repo"),
        "path",
        module_name(F.col("path")).alias("module"),
        text.alias("content"),
    )


def _read_listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, content) of the files that Spark's readers see, and of those they pass over.

    Names that Spark sees match `glob` by Hadoop's rules and may be behind linked folders.
    """
    listed = _listed(spark, root, links=True)
    name, size = F.substring_index("path", "/", -1), F.coalesce("size", F.lit(0))
    hadoop = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    passed_over = F.col("path").rlike(r"(^|/)[_.]|\._COPYING_$") | (size == 0)
    wanted = F.udf(lambda p, n: fnmatch.fnmatch(p.rsplit("/", 1)[-1], glob) and (n == 0 or _is_hidden(p)), "boolean")
    seen = F.udf(lambda p, n: n > 0 and not _is_hidden(p), "boolean")
    matching = name.rlike(rf"(?s)\A(?:{hadoop})\z")
    names = stage(
        listed.where(~passed_over & matching)
        .unionByName(listed.where(passed_over & matching).where(seen("path", size)))
        .unionByName(listed.where(passed_over & ~F.col("linked")).where(wanted("path", size)))
        .select("path", "size"),
        "names",
    )
    n, total = names.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    uri = _arrow_uri(root.rstrip("/"))
    return _dealt(names.select("path"), n, total).mapInArrow(_contents(uri), "path string, content binary")


def module_name(path: Column) -> Column:
    """Dotted module name of a path relative to its repository."""
    dotted = F.replace(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"\.__init__$", "")


def read_vectors(spark: SparkSession, path: str, id_col: str, vector_col: str) -> DataFrame:
    """vectors(path, embedding): only the two columns are read."""
    return spark.read.parquet(path).select(
        F.col(id_col).alias("path"), F.col(vector_col).alias("embedding")
    )
