"""Registration driven by a file stream."""

from .trigger import register_available

__all__ = ["register_available"]
