"""A Spark session with the settings this engine is written for."""

from __future__ import annotations

import functools
import logging
import time

from pyspark.sql import SparkSession

log = logging.getLogger("gneiss")


def set_log_level(level: int | str) -> None:
    log.setLevel(level)


def timed(function):
    """Logs how long a call took."""

    @functools.wraps(function)
    def inner(*args, **kwargs):
        began = time.perf_counter()
        try:
            return function(*args, **kwargs)
        finally:
            log.info("%s took %.2f s", function.__qualname__, time.perf_counter() - began)

    return inner


def session(name: str = "gneiss", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
