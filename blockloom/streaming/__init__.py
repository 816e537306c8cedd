"""Files as they arrive: a document is complete in its file, so the stream needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.structure import StructureOptions, build_blocks
from ..sources import docx


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """binaryFile as a stream of DOCX files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path)


def write_blocks(files: DataFrame, out: str, checkpoint: str, options: StructureOptions | None = None, once: bool = True):
    """Blocks of arriving files, appended as Parquet; each micro-batch runs the batch plan."""
    options = options or StructureOptions(page_layout=False)

    def batch(df: DataFrame, _: int) -> None:
        build_blocks(docx.raw_blocks(docx.read_files(df)), options).write.mode("append").parquet(out)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
