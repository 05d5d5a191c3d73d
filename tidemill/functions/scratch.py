"""Folders for what is written between the steps of a query."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def own_folder() -> str:
    """A temporary folder of this process, for local mode."""
    return tempfile.mkdtemp(prefix="tidemill-")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name in the cluster's shared folder; where none is named, a temporary one in local mode, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = own_folder()
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
