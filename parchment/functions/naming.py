"""Names of exported files, keys of exports, hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {"png": "png", "jpeg": "jpg"}


def time_stamp(at: Column) -> Column:
    """YYYYMMDD_HHMMSS in the session's time zone."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def page_file_name(stamp: Column, index: Column, kind: str, prefix: str = "Scan_") -> Column:
    """Pages count from 1, with three digits at least."""
    return F.format_string(f"{prefix}%s_%03d.{EXTENSIONS[kind]}", stamp, index + 1)


def document_file_name(stamp: Column, extension: str, prefix: str = "Scan_") -> Column:
    return F.concat(F.lit(prefix), stamp, F.lit(f".{extension}"))


def export_key(page_lengths: Column, ocr_pages: Column) -> Column:
    """number of pages:their lengths:pages with text. It changes when an export is out of date."""
    joined = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return F.concat_ws(":", F.size(page_lengths).cast("string"), joined(page_lengths), joined(ocr_pages))


def is_local_host(host: Column) -> Column:
    """localhost, the loopback address, and whatever starts or ends like a private name."""
    starts = [host.startswith(p) for p in ("192.168.", "172.", "10.")]
    return host.isin("localhost", "127.0.0.1") | starts[0] | starts[1] | starts[2] | host.endswith(".local")
