"""Scans of attachments as they arrive, one micro-batch after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.scan import scanned
from ..sources.site import Site


def scan_stream(site: Site, arriving: DataFrame, results: str, checkpoint: str, now: int) -> StreamingQuery:
    """Scans each micro-batch of ``arriving`` (attachment_id) and writes its verdicts to a folder of its own.

    A batch that is run again after a failure overwrites its folder, so each verdict is there once. ``plans.scan.merged``
    puts the folder into the site's stored results: of an attachment that came in several batches the last verdict counts."""

    def each(ids: DataFrame, batch: int) -> None:
        scanned(site, now, ids=ids).write.mode("overwrite").parquet(f"{results}/batch={batch}")

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
