"""Incremental class extraction with Structured Streaming.

New ``*.java`` files and source archives arriving below a corpus root are picked up by the file
stream source (``binaryFile`` format), pruned, decoded and exploded into
class rows exactly like the batch path (E11), and appended to a Parquet
table. The query keeps its progress in a checkpoint location, so a restarted
or failed run resumes where it stopped and every file is extracted once.
Extraction is per file (no state), so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as C
from ..operators.extract import classes_from_files
from ..sources import files as FS

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def class_stream(spark: SparkSession, root: str, max_files_per_trigger: int | None = None,
                 numeric_projects: bool = False) -> DataFrame:
    """A streaming DataFrame of class rows for files appearing below ``root``.

    project_id is the folder's name; ``numeric_projects`` makes it a bigint where all names are numbers.
    """
    def files(glob: str) -> DataFrame:
        reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
                  .option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", glob))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        return reader.load(root).select("path", "content")

    members = FS.archive_members(files("*" + FS.ARCHIVE_SUFFIX)).select("path", "content")
    listing = FS.with_project(files("*" + C.SOURCE_SUFFIX).unionByName(members), root, numeric=numeric_projects)
    rel = FS.relative_path(F.col("path"), F.col("root"))
    java_files = (listing.select("*", rel.alias("relative_path"))
                  .where(FS.keep_unpruned(F.col("relative_path")))
                  .select("project_id", F.col("path").alias("file_path"), "relative_path",
                          FS.decode_text(F.col("content")).alias("content")))
    return classes_from_files(java_files)


def start_class_ingest(spark: SparkSession, root: str, table_path: str, checkpoint_location: str,
                       available_now: bool = True, processing_time: str | None = None,
                       numeric_projects: bool = False) -> StreamingQuery:
    """Append extracted class rows to a Parquet table at ``table_path``."""
    w = (class_stream(spark, root, numeric_projects=numeric_projects).writeStream.format("parquet")
         .option("path", table_path).option("checkpointLocation", checkpoint_location)
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "30 seconds")
    return w.start()
