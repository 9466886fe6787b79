"""Repository addresses: which inputs are remote, and what a clone is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of a remote address.
REMOTE = ("https://github.com/", "http://github.com/", "git@github.com:")


def is_remote(address: Column, beginnings: tuple[str, ...] = REMOTE) -> Column:
    found = F.lit(False)
    for b in beginnings:
        found = found | address.startswith(b)
    return found


def clone_name(address: Column) -> Column:
    """The last segment without a trailing ``.git``."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(address, "/+$", ""), "([^/:]+)$", 1), r"\.git$", "")
