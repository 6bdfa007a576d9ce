"""Searches inside texts that skip files: a bitmap of trigrams per stored file.

Every run of three characters of a file's searched texts sets a bit. A text that contains a needle
has all the needle's trigrams, so a file without one of their bits need not be read; the rows of the
others are matched as ever. Texts are folded before they are cut, as the searches fold them. The
bitmaps are written beside the table when an upload is appended, and replaced with it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.functions.text import fold, literal_runs
from deskloom.operators import filters as FI
from deskloom.operators.ingest import append_tickets
from deskloom.operators.schema_ops import read_field
from deskloom.session import ship

#: Positions of a file's bitmap, kept in parts of 32,768.
POSITIONS = 1 << 20
#: With more files to read than this, the whole table is read.
MOST_FILES = 10_000
#: Trigrams of a file's texts of one kind that a task remembers, a power of two.
SEEN = 1 << 18

_TEXTS = {
    "search": FI.haystack,
    "store": lambda df: F.coalesce(fold(read_field(df, "store_name")), F.lit("")),
}


def _codes(texts: list[str]) -> np.ndarray:
    """Every run of three characters of each text, as one number."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(chars) < 3:
        return np.empty(0, np.uint64)
    inside = np.ones(len(chars), bool)
    ends = np.cumsum([len(t) for t in texts])
    for back in (1, 2):  # runs from a text's last two characters would reach into the next text
        inside[np.maximum(ends - back, 0)[ends >= back]] = False
    inside = inside[:-2]
    return (chars[:-2] << np.uint64(42) | chars[1:-1] << np.uint64(21) | chars[2:])[inside]


def _as_texts(codes: np.ndarray) -> list[str]:
    mask = np.uint64((1 << 21) - 1)
    chars = np.stack([codes >> np.uint64(42), codes >> np.uint64(21) & mask, codes & mask], axis=1).astype("<u4")
    text = chars.tobytes().decode("utf-32-le")
    return [text[i : i + 3] for i in range(0, len(text), 3)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, kind, trigram`` of rows with ``file`` and a text per kind.

    A trigram comes once per batch at most, and not again while the task remembers it for its file.
    """
    seen, current = {}, None
    for batch in batches:
        files = batch.column("file").dictionary_encode()
        places = files.indices.to_numpy()
        starts = np.append(0, np.flatnonzero(places[1:] != places[:-1]) + 1) if len(places) else []
        for start, end in zip(starts, [*starts[1:], len(places)]):
            file = files.dictionary[int(places[start])].as_py()
            if file != current:
                current, seen = file, {kind: np.full(SEEN, ~np.uint64(0)) for kind in _TEXTS}
            for kind, known in seen.items():
                codes = _codes(batch.column(kind).slice(start, end - start).to_pylist())
                slot = codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40) & np.uint64(SEEN - 1)
                new, first = np.unique(codes[known[slot] != codes], return_index=True)
                known[slot[known[slot] != codes][first]] = new
                if len(new):
                    yield pa.record_batch([pa.array([file] * len(new)), pa.array([kind] * len(new)), pa.array(_as_texts(new))], names=["file", "kind", "trigram"])


def _position(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(POSITIONS))


def _bits_path(path: str) -> str:
    return f"{path.rstrip('/')}-trigrams"


def bitmaps(stored: DataFrame) -> DataFrame:
    """``file, kind, part, bits`` of rows with their ``file``: set bits of a part of the positions."""
    ship(stored.sparkSession)
    texts = stored.select("file", *[text(stored).alias(kind) for kind, text in _TEXTS.items()])
    runs = texts.mapInArrow(_runs, "file string, kind string, trigram string")
    placed = runs.select("file", "kind", _position(F.col("trigram")).alias("p"))
    return placed.groupBy("file", "kind", F.bitmap_bucket_number("p").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    )


def append_indexed(df: DataFrame, path: str, upload_id: str) -> None:
    """Append an upload and the bitmaps of its files; run again, both are replaced.

    A file gets its bitmaps after it is there. Until then searches read it.
    """
    spark = df.sparkSession
    append_tickets(df, path, upload_id)
    stored = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"))
    new = bitmaps(stored.where(F.col("upload_id") == upload_id)).withColumn("upload_id", F.lit(upload_id))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(_bits_path(path))


def _needed(spark: SparkSession, runs: list[str]) -> dict[int, list[int]]:
    """Bits of each part that a text with all these runs must have."""
    found = {r[i : i + 3] for r in runs for i in range(len(r) - 2)}
    cut = spark.createDataFrame([(t,) for t in found], "t string")
    p = _position(F.col("t"))
    parts = defaultdict(list)
    for row in cut.select(F.bitmap_bucket_number(p).alias("part"), F.bitmap_bit_position(p).alias("bit")).distinct().collect():
        parts[row["part"]].append(row["bit"])
    return parts


def _has(bit: int) -> Column:
    byte = F.conv(F.hex(F.substring("bits", bit // 8 + 1, 1)), 16, 10).cast("int")
    return byte.bitwiseAND(1 << bit % 8) > 0


def files_to_read(spark: SparkSession, path: str, kind: str, runs: list[str]) -> list[str] | None:
    """The files that may hold a text with all these folded runs; None if there are too many to name."""
    stored = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    needed = _needed(spark, runs) if runs else {}
    if needed:
        known = spark.read.parquet(_bits_path(path)).select("file", "kind", "part", "bits")
        wanted = F.lit(False)
        for part, bits in needed.items():
            here = F.col("part") == part
            for bit in bits:
                here = here & _has(bit)
            wanted = wanted | here
        full = known.where((F.col("kind") == kind) & F.col("part").isin(list(needed)) & wanted).groupBy("file").count()
        full = full.where(F.col("count") == len(needed)).select("file")
        # Files that have no bitmaps yet are read too.
        fresh = stored.join(known.select("file").distinct(), "file", "left_anti")
        stored = stored.join(full.unionByName(fresh).distinct(), "file", "left_semi")
    found = [r["file"] for r in stored.limit(MOST_FILES + 1).collect()]
    return None if len(found) > MOST_FILES else found


def _read(spark: SparkSession, path: str, files: list[str] | None) -> DataFrame:
    table = spark.read.parquet(path)
    if files is not None:
        # A filter on the files' names is applied before any file is opened.
        table = table.where(F.col("_metadata.file_path").isin(files)) if files else table.where(F.lit(False))
    return table.drop("upload_id")


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """``filters.search`` over a stored table."""
    folded = spark.range(1).select(F.lower(F.lit(query)).alias("q")).first()["q"]
    return FI.search(_read(spark, path, files_to_read(spark, path, "search", [folded])), query)


def by_store(spark: SparkSession, path: str, store: str) -> DataFrame:
    """``filters.by_store`` over a stored table; between wildcards, each run of letters is looked up."""
    runs = [r["r"] for r in spark.createDataFrame([(r,) for r in literal_runs(store)] or [("",)], "r string").select(fold(F.col("r")).alias("r")).collect()]
    return FI.by_store(_read(spark, path, files_to_read(spark, path, "store", runs)), store)
