"""Numbers for the new lines of a stream: the same ones that a single run over all files would give (survey 2.9, D3).

The state is a table, one folder for each micro-batch: every line that was ever numbered. It is as large as the dictionary,
partitioned, and read by joins like any table; so no task holds it, and it outlives the stream's own checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.dictionary import first_seen
from ..operators.scan import positions

_STATE = "text string, number long, file string, line_no int, modified timestamp, batch long"


def _known(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """What earlier micro-batches numbered; a batch that is run again doesn't see its own first attempt."""
    try:
        return spark.read.schema(_STATE).parquet(out).where(F.col("batch") < batch_id)
    except AnalysisException:
        return spark.createDataFrame([], _STATE)


def number_lines(batch: DataFrame, batch_id: int, out: str, late: str | None = None) -> None:
    """Numbers the lines (``file, modified, line_no, line``) of one micro-batch that no earlier one had, in the order of files, by name, and lines.

    Numbers go on from the highest one. With ``late``, lines of files modified longer than that before the newest file of
    earlier batches are left out. Empty and null lines have no number. Writing the same batch again replaces it.
    """
    spark = batch.sparkSession
    known = _known(spark, out, batch_id)
    rows = batch.where("line <> ''").select(F.col("line").alias("text"), "file", "line_no", "modified")
    count, newest = known.agg(F.coalesce(F.max("number") + 1, F.lit(0)), F.max("modified")).first()
    if late and newest is not None:
        rows = rows.where(F.col("modified") >= F.lit(newest) - F.expr(f"interval {late}"))
    new = first_seen(rows, "text", ["file", "line_no", "modified"]).join(known.select("text"), "text", "left_anti")
    numbered = positions(new.select("text", "first.*"), ["file", "line_no"], "pos")
    made = numbered.select("text", (F.col("pos") + F.lit(count)).alias("number"), "file", "line_no", "modified")
    made.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def numbered_dictionary(lines: DataFrame, out: str, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Runs :func:`number_lines` on what there is now; a later call with the same folders goes on from there.

    Numbers are those of one run over all files if files arrive in the order of their names.
    """
    writer = lines.writeStream.foreachBatch(lambda batch, batch_id: number_lines(batch, batch_id, out, late))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
