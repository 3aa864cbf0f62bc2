"""Results of requests, kept by request and time bucket.

A result is a Parquet table that its writer's commit marker makes whole; a lost or unfinished attempt is never read. Two
runs that miss at the same time both write, each into a folder of its own, and all later ones read the first of these by
name. Nothing is renamed, so any store will do. Buckets that are over for long are deleted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession


class RequestCache:
    """Results under root, each good for its bucket of time (bucket, counted from 1970, UTC)."""

    def __init__(self, spark: SparkSession, root: str, bucket: timedelta):
        if bucket <= timedelta(0):
            raise ValueError("a bucket takes some time")
        self.spark, self.root, self.bucket = spark, root.rstrip("/"), bucket
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, request: dict, now: datetime) -> str:
        """The request's parameters in any order name its folder, the bucket's number one within it."""
        name = hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()
        return f"{self.root}/{name}/{(now - datetime(1970, 1, 1)) // self.bucket}"

    def _within(self, folder: str) -> list[str]:
        place = self._path(folder)
        if not self._fs.exists(place):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place))

    def _whole(self, folder: str) -> str | None:
        done = (f"{folder}/{a}" for a in self._within(folder))
        return next((a for a in done if self._fs.exists(self._path(f"{a}/_SUCCESS"))), None)

    def get(self, request: dict, now: datetime, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of a request in the bucket of now; make() only where there is none yet."""
        folder = self._folder(request, now)
        if self._whole(folder) is None:
            make().write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{folder}/{uuid.uuid4().hex}")
        return self.spark.read.parquet(self._whole(folder))

    def evict(self, now: datetime, after: timedelta) -> int:
        """Delete the buckets that ended longer ago than after; returns how many there were."""
        gone = 0
        for request in self._within(self.root):
            for number in self._within(f"{self.root}/{request}"):
                if datetime(1970, 1, 1) + (int(number) + 1) * self.bucket < now - after:
                    self._fs.delete(self._path(f"{self.root}/{request}/{number}"), True)
                    gone += 1
        return gone
