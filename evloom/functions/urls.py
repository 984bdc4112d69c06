"""URL and path safety checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(c: Column, name: str) -> Column:
    return F.try_parse_url(c, F.lit(name))


def safe_external_url(c: Column) -> Column:
    return F.when(F.lower(_part(c, "PROTOCOL")).isin("http", "https") & (F.coalesce(_part(c, "HOST"), F.lit("")) != ""), c)


def https_url(c: Column) -> Column:
    ok = (F.lower(_part(c, "PROTOCOL")) == "https") & (F.coalesce(_part(c, "HOST"), F.lit("")) != "")
    return F.when(ok & _part(c, "USERINFO").isNull(), c)


def approved_download(c: Column, hosts: list[str]) -> Column:
    """https only, host on the caller's list, no credentials, default port."""
    port = F.regexp_extract(F.coalesce(_part(c, "AUTHORITY"), F.lit("")), r":(\d+)\z", 1)
    ok = (_part(c, "PROTOCOL") == "https") & F.lower(_part(c, "HOST")).isin(*hosts)
    return F.coalesce(ok & _part(c, "USERINFO").isNull() & port.isin("", "443"), F.lit(False))


def safe_relative_path(c: Column) -> Column:
    """Non-empty, not absolute, no parent step, no backslash."""
    bad = c.rlike(r"^/") | c.rlike(r"(?:^|/)\.\.(?:/|\z)") | F.contains(c, F.lit("\\"))
    return F.coalesce((c != "") & ~bad, F.lit(False))
