"""Session settings the results depend on, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

_own_folders: dict[str, str] = {}


# Runtime settings that change results: calendar parts follow UTC, casts are strict.
STRICT = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Set them for the whole session."""
    for key, value in STRICT.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster pass your own to `configure`."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("agorametric")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@contextmanager
def temporary_settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime settings for the jobs started inside the block."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


# Independent steps that run at the same time; more would only wait for each other's tasks.
AT_ONCE = 4


def together(spark: SparkSession, *steps: Callable[[], None]) -> None:
    """Runs steps that don't need each other's results, so that one's tasks fill the cores another leaves idle.

    They start under the caller's settings, which no step may change. All have ended when this returns, or raises what
    the first failing step raised.
    """
    with ThreadPoolExecutor(AT_ONCE) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    for one in running:
        one.result()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder the cluster shares (`spark.checkpoint.dir`).

    A temporary folder stands in only on a local master, where every task sees it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
        app = context.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="agorametric-")
        base = _own_folders[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
