"""Source-file scan (S1-S6): a tree of ``*.java`` files -> ``java_files``.

* S1: ``binaryFile`` with recursive lookup and a ``*.java`` glob; listing and
  reading are distributed by Spark (one task per file split).
* S2: files below a pruned directory name (below the root) are dropped by a
  filter on the path, before ``content`` is touched.
* S3: bytes -> text: invalid UTF-8 dropped, universal newlines.
* S4: relative path = path below the project root.
* S5: unreadable / vanished files are skipped (``ignoreCorruptFiles`` /
  ``ignoreMissingFiles``); decoding is null-safe.
* S6: files per project without pruning.
* Archives: ``*-sources.jar`` files (zip) hold many source files below their own folder, as if they were unpacked
  there; their members are read in the tasks. A tree of many small files goes through Spark's listing
  in the driver and takes a block per file and folder; the same tree in archives takes neither.

Projects are the first-level folders of the scanned root: one scan covers
a whole corpus. Their ids are numbers if all folder names are, else strings; with
``project`` the root itself is one project of that name.
"""

from __future__ import annotations

import io
import os
import zipfile
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import str_array
from ..session import ship_package

PID = "project_id"
ARCHIVE_SUFFIX = "-sources.jar"
#: Bytes of text that an archive written here holds; bytes and members of a batch read from archives.
ARCHIVE_BYTES, BATCH_BYTES, BATCH_MEMBERS = 16 << 20, 8 << 20, 5000


def scan_sources(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """S1 + S5: (path, length, content binary) of every ``*.java`` file below ``root``, those in archives included.

    Without ``content`` the column is null for members of archives, which are then listed only.
    """
    def files(glob: str) -> DataFrame:
        return (spark.read.format("binaryFile")
                .option("recursiveFileLookup", "true")
                .option("pathGlobFilter", glob)
                .option("ignoreCorruptFiles", "true")
                .option("ignoreMissingFiles", "true")
                .load(root)
                .select("path", "length", "content"))

    return files("*" + C.SOURCE_SUFFIX).unionByName(archive_members(files("*" + ARCHIVE_SUFFIX), content))


def _listed(member: str) -> bool:
    """Whether Spark would list the file: no hidden name on its way."""
    parts = member.split("/")
    return parts[-1].endswith(C.SOURCE_SUFFIX) and not any(
        p.startswith(".") or (p.startswith("_") and "=" not in p) or p.endswith("._COPYING_") for p in parts)


def archive_members(archives: DataFrame, content: bool = True) -> DataFrame:
    """(path, length, content) of the source files in the archives (path, content).

    A member that can't be read is listed, but has no row with content; a file that is no archive has no members.
    """
    ship_package(archives.sparkSession)
    names = ["path", "length", "content"]
    kinds = [pa.string(), pa.int64(), pa.binary()]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(batches):
        out, held = [], 0
        for batch in batches:
            for path, body in zip(batch.column(0), batch.column(1)):
                folder = path.as_py().rsplit("/", 1)[0]
                try:
                    archive = zipfile.ZipFile(io.BytesIO(body.as_py()))
                except zipfile.BadZipFile:
                    continue
                for info in archive.infolist():
                    if not _listed(info.filename):
                        continue
                    text = None
                    if content:
                        try:
                            text = archive.read(info)
                        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
                            continue
                    out.append((folder + "/" + info.filename, info.file_size, text))
                    held += info.file_size if content else 0
                    if held > BATCH_BYTES or len(out) >= BATCH_MEMBERS:
                        yield packed(out)
                        out, held = [], 0
        if out:
            yield packed(out)

    return archives.select("path", "content").mapInArrow(run, "path string, length long, content binary")


def _root_uri(spark: SparkSession, root: str) -> str:
    """The root as Spark spells the paths below it, whatever its own spelling or file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def with_project(listing: DataFrame, root: str, project: str | None = None, numeric: bool = False) -> DataFrame:
    """Adds project_id (first folder below ``root``, or ``project``) and the project root path.

    A project_id is a string, whatever the folders are called; ``numeric`` says that all names are numbers and
    makes it a bigint (a folder with another name is then an error).
    """
    base = _root_uri(listing.sparkSession, root) + "/"
    rest = F.substring(F.col("path"), len(base) + 1, 1 << 30)
    below = listing.where(F.startswith(F.col("path"), F.lit(base)))
    if project is not None:
        return below.select("*", F.lit(project).alias(PID), F.lit(base.rstrip("/")).alias("root"))
    pid = F.element_at(F.split(rest, "/", 2), 1)
    return below.select("*", (pid.cast("bigint") if numeric else pid).alias(PID), F.concat(F.lit(base), pid).alias("root"))


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root`` (no leading slash)."""
    return F.substring(path, F.length(root) + 2, 1 << 30)


def keep_unpruned(rel: Column) -> Column:
    """No directory of the relative path (the file name excluded) is a pruned name."""
    dirs = F.slice(F.split(rel, "/", -1), 1, F.greatest(F.size(F.split(rel, "/", -1)) - 1, F.lit(0)))
    return ~F.exists(dirs, lambda d: F.array_contains(str_array(C.PRUNED_DIRS), d))


def decode_text(content: Column) -> Column:
    """S3: UTF-8 text; invalid bytes removed; '\\r\\n' and '\\r' become '\\n'."""
    raw = content.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    return F.regexp_replace(text, "\r\n?", "\n")


def java_files_from_tree(spark: SparkSession, root: str, project: str | None = None, numeric: bool = False) -> DataFrame:
    """S1-S5 composed: java_files(project_id, file_path, relative_path, content)."""
    listing = with_project(scan_sources(spark, root), root, project, numeric)
    rel = relative_path(F.col("path"), F.col("root"))
    kept = listing.select("*", rel.alias("relative_path")).where(keep_unpruned(F.col("relative_path")))
    return kept.select(PID, F.col("path").alias("file_path"), "relative_path",
                       decode_text(F.col("content")).alias("content"))


def bad_files(spark: SparkSession, root: str, project: str | None = None, numeric: bool = False) -> DataFrame:
    """(project_id, relative_path, reason) of the files that the class table lacks or holds in part.

    ``unreadable``: listed, but reading gave an error (such a file is left out of the scan). ``invalid UTF-8``: read, with
    the bad bytes dropped. Pruned folders are reported, too. The listing opens no file; paths only are shuffled.
    """
    listed = scan_sources(spark, root, content=False).select("path")
    read = scan_sources(spark, root).select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))
    bad = listed.join(read, "path", "left").where(~F.coalesce("valid", F.lit(False)))
    named = with_project(bad, root, project, numeric)
    return named.select(PID, relative_path(F.col("path"), F.col("root")).alias("relative_path"),
                        F.when(F.col("valid").isNull(), "unreadable").otherwise("invalid UTF-8").alias("reason"))


def source_file_counts(spark: SparkSession, root: str, project: str | None = None, numeric: bool = False) -> DataFrame:
    """``*.java`` files per project, before pruning (no content is read)."""
    listing = with_project(scan_sources(spark, root, content=False).select("path"), root, project, numeric)
    return listing.groupBy(PID).agg(F.count(F.lit(1)).alias("java_files"))


def paths_below_pruned(listing: DataFrame) -> DataFrame:
    """S2 on a plain listing (project_id, root, path): keep files not below a pruned folder."""
    rel = relative_path(F.col("path"), F.col("root"))
    return listing.select(PID, "path", rel.alias("relative_path")).where(keep_unpruned(F.col("relative_path")))


def local_path(uri: str) -> str:
    """'file:/a/b' or 'file:///a/b' -> '/a/b' (the tree writer needs a mounted path)."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    if "://" in uri:
        raise ValueError(f"source trees are written through a mounted path, not {uri}")
    return uri


def write_source_tree(java_files: DataFrame, root: str, layout: Column | None = None) -> str:
    """Write every row of ``java_files`` to ``root/<project_id>/<layout><relative_path>``.

    Distributed: each task writes the files of its own partition (text as UTF-8, or bytes as they are). ``layout``
    is an optional folder prefix column (e.g. to place some files below
    build-output folders).
    """
    mid = layout if layout is not None else F.lit("")
    local_root = local_path(root)
    rows = java_files.select(F.concat(F.lit(local_root.rstrip("/") + "/"), F.col(PID).cast("string"), F.lit("/"),
                                      mid, F.col("relative_path")).alias("target"), F.col("content").cast("binary").alias("content"))

    def write_part(it):
        for r in it:
            os.makedirs(os.path.dirname(r["target"]), exist_ok=True)
            with open(r["target"], "wb") as fh:
                fh.write(r["content"])

    rows.foreachPartition(write_part)
    return root


def write_source_archives(java_files: DataFrame, root: str, layout: Column | None = None) -> str:
    """The files of :func:`write_source_tree` as members of archives of about ARCHIVE_BYTES of text each.

    Distributed: each task writes the archives of its own partition, under names that a repeated attempt writes
    again. Of rows with one path a single one is kept.
    """
    mid = layout if layout is not None else F.lit("")
    local_root = local_path(root).rstrip("/")
    rows = java_files.select(F.concat(F.col(PID).cast("string"), F.lit("/"), mid, F.col("relative_path")).alias("target"),
                             F.col("content").cast("binary").alias("content"))

    def write_archive(name: str, members: list[tuple[str, bytes]]) -> None:
        os.makedirs(local_root, exist_ok=True)
        part = f"{local_root}/.{name}.{TaskContext.get().taskAttemptId()}"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            for target, body in members:
                z.writestr(zipfile.ZipInfo(target), body, zipfile.ZIP_DEFLATED, 1)
        os.replace(part, f"{local_root}/{name}")

    def write_part(it):
        members, held, seq = [], 0, 0
        name = lambda: f"part-{TaskContext.get().partitionId():05d}-{seq:05d}{ARCHIVE_SUFFIX}"
        for r in it:
            if members and members[-1][0] == r["target"]:
                held -= len(members.pop()[1])
            elif held > ARCHIVE_BYTES:
                write_archive(name(), members)
                members, held, seq = [], 0, seq + 1
            members.append((r["target"], bytes(r["content"])))
            held += len(members[-1][1])
        if members:
            write_archive(name(), members)

    ship_package(java_files.sparkSession)
    rows.repartition("target").sortWithinPartitions("target", "content").foreachPartition(write_part)
    os.makedirs(local_root, exist_ok=True)  # an empty table gives an empty tree
    return root
