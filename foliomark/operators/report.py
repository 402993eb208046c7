"""One status row per input file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import text as t
from ..functions import wording as w
from .documents import QUICK, engine_known


def failed_at(stage: Column | None, *stages: str) -> Column:
    """Whether the file failed (``error``) in one of these stages; without a stage, in the second tier."""
    given = F.lit(w.CONVERT) if stage is None else F.coalesce(stage, F.lit(w.CONVERT))
    return F.col("error").isNotNull() & given.isin(*stages)


def error_message(ocr_engine: str = w.DEFAULT_OCR_ENGINE, stage: Column | None = None) -> Column:
    """Why a file failed, from ``file, kind, route, error`` and maybe the ``stage`` it failed in; null if it did not.

    A wrong engine name only matters to files that need the second tier, and so does a
    failure there (``error``: a codec or an engine that stopped, in its own words).  What fails
    later - taking images out, writing - or the whole worker, fails quick files, too.
    """
    suffix = n.quoted(F.lower(n.suffix(F.col("file"))))
    message = F.when(failed_at(stage, w.WORKER), F.col("error"))
    message = message.when(F.col("kind").isNull(), t.fill(w.UNSUPPORTED_TYPE, suffix=suffix))
    if not engine_known(ocr_engine):
        options = "[" + ", ".join(f"'{name}'" for name in w.OCR_ENGINES) + "]"
        unknown = t.fill(
            w.UNSUPPORTED_ENGINE, engine=n.quoted(F.lit(ocr_engine)), options=F.lit(options)
        )
        message = message.when(F.col("route") != QUICK, unknown)
    message = message.when((F.col("route") != QUICK) & failed_at(stage, w.CONVERT), F.col("error"))
    return message.when(failed_at(stage, w.COUNT, w.WRITE), F.col("error"))


def file_status(ocr_engine: str = w.DEFAULT_OCR_ENGINE, stage: Column | None = None) -> Column:
    message = error_message(ocr_engine, stage)
    return F.when(message.isNull(), w.STATUS_OK).otherwise(
        t.fill(w.STATUS_ERROR, message=F.coalesce(message, F.lit("")))
    )


def run_report(documents: DataFrame) -> DataFrame:
    """``file, pages, engine, status, output``; a dash where nothing was written."""
    return documents.select(
        "file",
        "pages",
        "engine",
        "status",
        F.coalesce("output", F.lit(w.NO_OUTPUT)).alias("output"),
    )


def output_collisions(documents: DataFrame) -> DataFrame:
    """Output names that several files share; as files, the last one written would win."""
    return (
        documents.where(F.col("output").isNotNull())
        .groupBy("output")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .where(F.col("n_files") > 1)
    )


def report_figures(report: DataFrame, name: str = "report") -> tuple[DataFrame, Observation]:
    """``report`` and its figures, gathered while it is written: no job counts them.

    ``Observation.get`` waits for the first job over the returned table and gives files, ok, failed, pages and
    quick (files that the quick converter did).
    """
    ok = F.col("status") == w.STATUS_OK
    figures = Observation(name)
    observed = report.observe(
        figures,
        F.count(F.lit(1)).alias("files"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.col("pages").cast("bigint")), F.lit(0)).alias("pages"),
        F.count_if(F.col("engine") == w.QUICK_ENGINE).alias("quick"),
    )
    return observed, figures
