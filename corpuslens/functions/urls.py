"""Base-URL normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import trim_ws

# fixed values: endpoints that are cut off a base URL
ENDPOINTS = ["/chat/completions", "/embeddings", "/models"]


def base_url(x: str | Column, endpoints: list[str] = ENDPOINTS) -> Column:
    """A base URL without slashes or a known endpoint at its end; null unless it is http(s) with a host and no query."""
    v = F.regexp_replace(trim_ws(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))), "/+$", "")
    good = v.rlike(r"(?i)^https?://[^/?#\s]+(/[^?#\s]*)?$")
    cut = v
    for e in reversed(endpoints):
        cut = F.when(v.endswith(e), v.substr(F.lit(1), F.length(v) - len(e))).otherwise(cut)
    return F.when(good, cut)


def fixed_host_url(x: str | Column, host: str, root: str, aliases: list[str], default: str) -> Column:
    """A base URL of one host: no path and older paths become ``root``; other hosts and blank texts become ``default``."""
    v = F.regexp_replace(trim_ws(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))), "/+$", "")
    origin = F.regexp_extract(v, r"(?i)^(https?://[^/?#\s]+)", 1)
    path = F.regexp_extract(v, r"(?i)^https?://[^/?#\s]+([^?#\s]*)$", 1)
    own = F.lower(F.regexp_extract(origin, "//([^:/]+)", 1)) == host.lower()
    return F.when(~own, F.lit(default)).when(path.isin("", *aliases), F.concat(origin, F.lit(root))).otherwise(v)
