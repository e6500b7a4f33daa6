"""The whole scan as one lazy plan: contexts, references of all detectors, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.context import contexts
from ..operators.detectors import Detector, all_references
from ..operators.results import latest, saved, status_counts, verdicts
from ..operators.state import BATCH, LastScan, State, Store, next_batch
from ..operators.stored import Results
from ..sources.site import COLUMNS, Site

#: Attachments that are looked up by literal filters, at the most.
FEW = 50


def references(site: Site, ids: DataFrame | None = None, detectors: dict[str, Detector] | None = None) -> DataFrame:
    """References of all attachments, or of those in ``ids`` (attachment_id)."""
    return all_references(site, chosen(site, ids), detectors)


def chosen(site: Site, ids: DataFrame | None) -> DataFrame:
    found = contexts(site.attachments)
    return found if ids is None else found.join(ids.select("attachment_id").distinct(), "attachment_id", "left_semi")


def needles_of(contexts: DataFrame, most: int = FEW) -> list[str] | None:
    """All ids and names of a few attachments, or none if there are more than ``most``: then every text is looked at, with the same result."""
    found = contexts.select("id_text", "basenames").limit(most + 1).collect()
    return None if len(found) > most else sorted({x for r in found for x in (r["id_text"], *r["basenames"])})


def scanned_few(site: Site, ids: DataFrame, now: int) -> DataFrame:
    """``scanned`` for a few ids: the scan of each text table keeps the rows that hold an id or a name of them, as literals in its filter."""
    few = chosen(site, ids)
    return verdicts(few, all_references(site, few, needles=needles_of(few)), now)


def scanned(site: Site, now: int, ids: DataFrame | None = None, detectors: dict[str, Detector] | None = None, is_used: Callable[[Column, DataFrame], Column] | None = None) -> DataFrame:
    """Verdicts: attachment_id, status, ref_count, refs_json, scanned_at."""
    return verdicts(chosen(site, ids), references(site, ids, detectors), now, is_used)


def scan_batch(site: Site, store: Store, results: str, now: int, size: int = BATCH) -> State | LastScan:
    """Scans the next batch of a stored scan (a new one, if none is running) into its folder of ``results``, and stores how far it came.

    A batch that is cut off before its state is stored is scanned again and overwritten. When no id is left
    the scan is finished, with the counts of ``merged`` results. If another driver has written the state meanwhile, this one
    gets a ``commits.Conflict``: what it scanned is the other's next batch, or older."""
    seq, state = store.seq(), store.current()
    if state is None:
        state = store.start(site.attachments.count(), now, after=seq)
        seq = store.seq()
        site.results.limit(0).write.mode("overwrite").parquet(f"{results}/batch=-1")  # so that there are results, if none of attachments
    ids = next_batch(site, state, size)
    end = ids.agg(F.max("attachment_id").alias("cursor"), F.count("*").alias("n")).first()
    if not end["n"]:
        unused = status_counts(site.attachments, merged(site, results), site.collation).first()["unused"]
        return store.finish(unused, now, after=seq)
    scanned(site, now, ids=ids).write.mode("overwrite").parquet(f"{results}/batch={state.done}")
    return store.advance(end["cursor"], end["n"], now, after=seq)


def scan_into(site: Site, store: Store, results: Results, now: int, size: int = BATCH) -> State | LastScan:
    """``scan_batch`` with results that are put into a stored table, batch by batch: whoever reads it has each verdict as soon as its batch is saved."""
    seq, state = store.seq(), store.current()
    if state is None:
        state = store.start(site.attachments.count(), now, after=seq)
        seq = store.seq()
    ids = next_batch(site, state, size)
    end = ids.agg(F.max("attachment_id").alias("cursor"), F.count("*").alias("n")).first()
    if not end["n"]:
        return store.finish(status_counts(site.attachments, results.read(), site.collation).first()["unused"], now, after=seq)
    results.save(scanned(site, now, ids=ids))
    return store.advance(end["cursor"], end["n"], now, after=seq)


def merged(site: Site, results: str) -> DataFrame:
    """The site's stored results with those of a folder of batches put in: of an attachment in several, the last."""
    stored = site.results.sparkSession.read.schema(f"{COLUMNS['results']}, batch long").parquet(results)
    return saved(site.results, latest(stored).select(*site.results.columns))
