"""Opinion analytics on Spark: staging, audit, cleaning, marts and reports over one wide table of posts."""

from agorametric.session import configure, local_session
from agorametric.settings import Settings

__all__ = ["Settings", "configure", "local_session"]
