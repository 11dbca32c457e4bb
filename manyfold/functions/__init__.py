"""Column functions."""

from .glob import glob_matches, glob_regex

__all__ = ["glob_matches", "glob_regex"]
