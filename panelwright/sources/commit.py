"""Small steps on a shared folder that happen once or not at all: names that only one job gets,
and files that appear whole."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def claim(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if it was there. Of several jobs that claim one path at the same
    time, one gets it."""
    fs, place = _place(spark, path)
    fs.mkdirs(place.getParent())
    try:
        if fs.getScheme() == "file":  # Hadoop looks before it creates here, the system does both at once
            jvm = spark.sparkContext._jvm
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(place.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(place, False).close()
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def put(spark: SparkSession, path: str, text: str) -> None:
    """A file that is seen with all of its text or not at all; its name must not be in use."""
    fs, place = _place(spark, path)
    fs.mkdirs(place.getParent())
    _, draft = _place(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, place):
        raise PySparkException(f"{path} could not be written")


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder; none if it is not there."""
    fs, place = _place(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def text_of(spark: SparkSession, path: str) -> str:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return bool(fs.delete(place, True))


_VERSION = re.compile(r"manifest-(\d+)\.json")


def newest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest committed last."""
    numbers = [int(m.group(1)) for m in map(_VERSION.fullmatch, names(spark, folder)) if m]
    return json.loads(text_of(spark, f"{folder}/manifest-{max(numbers):08d}.json")) if numbers else None


def commit(spark: SparkSession, folder: str, manifest: dict) -> int:
    """Makes ``manifest`` the newest one; its number is claimed first, so that no two jobs write one
    file, and the file appears whole."""
    numbers = [int(m.group(1)) for m in map(re.compile(r"(?:manifest|claim)-(\d+).*").fullmatch, names(spark, folder)) if m]
    number = max(numbers, default=0) + 1
    while not claim(spark, f"{folder}/claim-{number:08d}"):
        number += 1
    put(spark, f"{folder}/manifest-{number:08d}.json", json.dumps(manifest, sort_keys=True))
    return number
