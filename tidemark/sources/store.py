"""Files of a shared store, from the driver and from tasks alike, and the lease of its single writer."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession


class LeaseHeld(RuntimeError):
    """Another writer owns the output."""


class Fenced(RuntimeError):
    """The writer's lease was taken over: it may not commit."""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a local path or any uri that Arrow knows."""
    if re.match(r"^[a-z0-9+.-]+:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def file_name(key: str) -> str:
    """A key as the name of a file in any store."""
    return quote(key, safe="")


def read_bytes(path: str) -> bytes | None:
    """The bytes of a file, None if there is none."""
    store, p = opened(path)
    if store.get_file_info(p).type != fs.FileType.File:
        return None
    with store.open_input_stream(p) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    """Write a file unchanged, folders included; readers see all of it or nothing."""
    store, p = opened(path)
    folder = p.rsplit("/", 1)[0]
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, p)


def listed(folder: str) -> list[str]:
    """Names in a folder, without hidden ones; none if it is not there."""
    store, p = opened(folder)
    found = store.get_file_info(fs.FileSelector(p, allow_not_found=True))
    return sorted(f.base_name for f in found if not f.base_name.startswith("."))


def delete(path: str) -> None:
    store, p = opened(path)
    if store.get_file_info(p).type == fs.FileType.File:
        store.delete_file(p)


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Create a file if there is none; of several that try at once, one succeeds."""
    store, p = opened(path)
    store.create_dir(p.rsplit("/", 1)[0], recursive=True)
    if isinstance(store, fs.LocalFileSystem):
        try:
            at = os.open(p, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(at, "wb") as f:
            f.write(data)
        return True
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    except Exception as e:  # py4j wraps the store's own exception
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(data))
    out.close()
    return True


@dataclass
class Lease:
    """The right to write an output, numbered: a later number fences all earlier ones.

    A lease is a file ``leases/<number>`` that only one writer can create; it holds until its time is over or it is
    released. The number is checked again when the writer commits.
    """

    spark: SparkSession
    output: str
    number: int
    owner: str
    seconds: float
    clock: Callable[[], float] = time.time

    @staticmethod
    def _state(output: str, number: int) -> dict:
        """What is known of a lease; one whose file is still empty is being taken."""
        latest = read_bytes(f"{output}/leases/{number:012d}.until") or read_bytes(f"{output}/leases/{number:012d}")
        return json.loads(latest) if latest else {"owner": "?", "until": float("inf")}

    @classmethod
    def acquire(cls, spark: SparkSession, output: str, owner: str, seconds: float = 60.0, clock: Callable[[], float] = time.time) -> Lease:
        """The next lease of an output; an error while another one holds."""
        last = highest(output)
        if last:
            held = cls._state(output, last)
            if held["until"] > clock():
                raise LeaseHeld(f"{held['owner']} writes {output}")
        lease = cls(spark, output, last + 1, owner, seconds, clock)
        if not create_once(spark, f"{output}/leases/{last + 1:012d}", lease._content(clock() + seconds)):
            raise LeaseHeld(f"another writer was first at {output}")
        return lease

    def _content(self, until: float) -> bytes:
        return json.dumps({"owner": self.owner, "until": until}).encode()

    def renew(self) -> None:
        """Hold on for another term; an error if the lease was taken over."""
        check_fence(self.output, self.number)
        write_bytes(f"{self.output}/leases/{self.number:012d}.until", self._content(self.clock() + self.seconds))

    def release(self) -> None:
        write_bytes(f"{self.output}/leases/{self.number:012d}.until", self._content(0.0))

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def highest(output: str) -> int:
    """The number of an output's last lease, 0 if there never was one."""
    return max((int(n.split(".")[0]) for n in listed(f"{output}/leases")), default=0)


def check_fence(output: str, number: int) -> None:
    if (last := highest(output)) != number:
        raise Fenced(f"lease {number} of {output} was taken over by {last}")
