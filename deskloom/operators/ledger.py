"""Number ranges that uploads reserve, so that two at once cannot draw the same numbers.

A ledger is a folder of numbered claims. An upload reads the last claim, works out the next free
numbers and creates the next file; where another one has been faster, the file is there already and
it tries again behind it. The file system has to refuse the second creation of a file, as HDFS and
disks do. A claim is never changed; numbers of an upload that is given up stay unused.
"""

from __future__ import annotations

import json
import time
from typing import NamedTuple
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from deskloom.operators.numbering import max_job_order, max_ticket_no

#: Seconds to wait for the text of a claim that another upload is just writing.
PATIENCE = 10.0


class Claim(NamedTuple):
    """Numbers of one upload: the highest ticket number and job order before it, and how many rows."""

    upload_id: str
    ticket_no: int
    job_order: int
    rows: int


class _Files:
    """Small files of one folder, by Spark's file system for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.folder = folder.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def create(self, name: str, text: str) -> bool:
        """Write a file, unless it is there already.

        Hadoop's local file system looks first and creates then, so on disks the exclusive creation
        of the operating system is used.
        """
        path = self._path(name)
        if self.fs.getUri().getScheme() == "file":
            self.fs.mkdirs(path.getParent())
            try:
                with open(path.toUri().getPath(), "x") as out:
                    out.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = self.fs.create(path, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        """The text of a file, once its writer has closed it."""
        path, deadline = self._path(name), time.monotonic() + PATIENCE
        while True:
            size = self.fs.getFileStatus(path).getLen()
            if size:
                data = self.fs.open(path)
                try:
                    text = bytes(data.readNBytes(int(size))).decode()
                finally:
                    data.close()
                if text.endswith("\n"):
                    return text
            if time.monotonic() > deadline:
                raise RuntimeError(f"claim {path.toString()} is not finished; remove it if its upload is gone")
            time.sleep(0.05)


def _name(number: int) -> str:
    return f"claims/{number:012d}.json"


def _last(files: _Files) -> int:
    """The number of the last claim, 0 without any, found by doubling and halving."""
    high = 1
    while files.exists(_name(high)):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if files.exists(_name(middle)) else (low, middle)
    return low


def _read(files: _Files, number: int) -> Claim:
    return Claim(**json.loads(files.read(_name(number))))


def _earlier(spark: SparkSession, folder: str, upload_id: str) -> Claim | None:
    """The claim of an upload that stopped before it noted its number."""
    claims = spark.read.schema("upload_id string, ticket_no bigint, job_order bigint, rows bigint").json(f"{folder}/claims")
    found = claims.where(claims["upload_id"] == upload_id).orderBy("ticket_no").first()
    return None if found is None else Claim(**found.asDict())


def reserve(folder: str, upload_id: str, rows: int, tickets: DataFrame) -> Claim:
    """Numbers for ``rows`` rows after all in the table and all that other uploads have reserved.

    An upload that is repeated gets its numbers again; it must have as many rows as before.
    """
    spark = tickets.sparkSession
    files, note = _Files(spark, folder), f"uploads/{quote(upload_id, safe='')}"
    if not files.create(f"{note}.begun", "\n"):
        done = files.exists(f"{note}.done")
        claim = _read(files, int(files.read(f"{note}.done"))) if done else None
        if claim is None and _last(files):
            claim = _earlier(spark, folder, upload_id)
        if claim is not None:
            if claim.rows != rows:
                raise ValueError(f"upload {upload_id!r} has {rows} rows, but reserved numbers for {claim.rows}")
            return claim
    number = _last(files)
    ticket_no, job_order = max_ticket_no(tickets).first()[0], max_job_order(tickets).first()[0]
    while True:
        if number:
            last = _read(files, number)
            ticket_no, job_order = max(ticket_no, last.ticket_no + last.rows), max(job_order, last.job_order + last.rows)
        claim = Claim(upload_id, ticket_no, job_order, rows)
        number += 1
        if files.create(_name(number), json.dumps(claim._asdict()) + "\n"):
            files.create(f"{note}.done", f"{number}\n")
            return claim
