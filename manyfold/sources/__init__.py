"""Configuration, storage, the catalog with its version log, and Parquet file footers."""

from .catalog import Catalog, CommitConflict, Snapshot
from .config import Config, ConfigError, from_environment, load_config
from .files import file_entries
from .tables import TableCatalog

__all__ = ["Catalog", "CommitConflict", "Config", "ConfigError", "Snapshot", "TableCatalog", "file_entries", "from_environment", "load_config"]
