"""Batch feature cleaning and many-user ranking as Spark jobs."""

from rankflow.config import Settings
from rankflow.session import session

__all__ = ["Settings", "session"]
