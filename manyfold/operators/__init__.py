"""Discovery, registration, reading and verification."""

from .discovery import common_tables, resolve_namespaces, skipped_tables
from .reader import live, read, scan_files
from .register import register_table, run
from .verify import verify, verify_table

__all__ = ["common_tables", "live", "read", "register_table", "resolve_namespaces", "run", "scan_files", "skipped_tables", "verify", "verify_table"]
