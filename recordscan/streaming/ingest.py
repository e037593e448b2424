"""Archives that arrive in a folder, read as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..engine import annotate
from ..options import SearchOptions
from ..sources.archives import ReadOptions, read_archive, batches, records_of
from ..schema import TAGGED


def tagged_stream(spark: SparkSession, folder: str, options: ReadOptions | None = None, per_trigger: int = 64) -> DataFrame:
    """Records, issues and counts of archives that appear in a folder, as a stream; each archive is read once, in one task."""
    import io

    options = options or ReadOptions()
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[zZ][iI][pP]").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)

    def run(found):
        for b in found:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                yield from batches(path, read_archive(io.BytesIO(content.as_py()), options))

    return files.select("path", "content").mapInArrow(run, TAGGED)


def match_stream(spark: SparkSession, folder: str, options: SearchOptions) -> DataFrame:
    """Matches of a search in archives that arrive: a standing query without rank or limit."""
    options.check()
    return annotate(records_of(tagged_stream(spark, folder, ReadOptions.of(options))), options)


def index_stream(spark: SparkSession, folder: str, index: str, checkpoint: str, once: bool = True):
    """Keep an index up to date with a folder: each micro-batch of new archives triggers an incremental update.

    The stream only notices what is new; the update itself compares
    fingerprints, so replaced and removed archives are taken care of, too.
    """
    from ..plans.index import build_or_update

    def update(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            build_or_update(batch.sparkSession, folder, index)

    schema = "path string, modificationTime timestamp, length long, content binary"
    seen = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[zZ][iI][pP]").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    writer = seen.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
