"""Readers. Each returns a lazy DataFrame; nothing is collected to the driver."""

from ledgerlens.sources.parallelism import ensure_parallelism
from ledgerlens.sources.codelist import read_code_list
from ledgerlens.sources.statements import read_statements

__all__ = ["ensure_parallelism", "read_code_list", "read_statements"]
