"""Statuses: their values, their order, and the rules that assign them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses, worst first.
SEVERITY = ("failed", "access_lost", "gap", "surplus", "unverifiable", "matched_against_archive", "pending", "matched", "not_applicable")
#: Statuses of a unit and of its reconciliation, in listing order.
UNIT_STATUS = ("pending", "running", "done", "failed", "retry_later", "paused")
RECON_STATUS = ("pending", "matched", "gap", "surplus", "unverifiable", "failed", "access_lost", "not_applicable", "matched_against_archive")
#: What a report lists as exceptions, and the kinds of observations.
EXCEPTIONS = ("failed", "access_lost", "gap", "surplus", "unverifiable")
OBSERVATIONS = ("file_unavailable", "file_became_available", "access_lost", "access_restored", "no_longer_observed", "observed_again")


def rank(status: Column) -> Column:
    """SRT-3: place in SEVERITY; unknown statuses come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status)
    return F.when(at > 0, at - 1).otherwise(len(SEVERITY)).cast("int")


def severity(status: Column, recon: Column) -> Column:
    """A failed unit outranks its reconciliation."""
    return F.when(status == "failed", "failed").otherwise(recon)


def unit_recon(kind: Column, access_lost: Column, expected: Column, collected: Column, file_gaps: Column, gap_reasons: Column, archive: Column | bool = False) -> Column:
    """AGG-1: reconciliation status of a unit; collected is the archive's count for archive units."""
    archive = F.lit(archive) if isinstance(archive, bool) else archive
    loose = (file_gaps > 0) | (F.size(gap_reasons) > 0)
    against = F.when(expected.isNotNull() & (collected == expected) & ~loose, "matched_against_archive").otherwise("gap")
    live = F.when(expected.isNull(), "unverifiable").when((collected < expected) | loose, "gap").when(collected > expected, "surplus").otherwise("matched")
    return F.when(kind == "directory", "not_applicable").when(access_lost, "access_lost").when(archive, against).otherwise(live)
