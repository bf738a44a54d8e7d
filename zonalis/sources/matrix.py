"""The binary movement matrix: a dense ``[minute, person]`` table of location numbers.

One zone's schedule is one buffer, so zones are encoded side by side; a buffer is bounded
by its zone, and reading gives the rows of one buffer at a time.
"""

from __future__ import annotations

import gzip
import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The format's magic, codes and field order, all little-endian.
MAGIC = b"DLNOPAT1"
HEADER = "<8sBBBBIIII"  # magic, layout, dtype, orientation, codec, minutes, people, locations, homes
DENSE, MINUTE_MAJOR = 0, 0
PLAIN, ZSTD, GZIP = 0, 1, 2
DTYPES = ("<u2", "<u4")

SCHEDULE = "minute int, person_id string, is_home boolean, location_id string"


def pack(matrix: np.ndarray, minutes: list[int], people: list[str], locations: list[str], homes: int, level: int = 3) -> bytes:
    """A buffer of the matrix; ``ValueError`` if its sizes or numbers do not fit the tables."""
    t, n = matrix.shape
    if n != len(people) or t != len(minutes):
        raise ValueError(f"a matrix of {t} x {n} for {len(minutes)} minutes and {len(people)} people")
    if matrix.size and int(matrix.max()) >= len(locations):
        raise ValueError("a location number beyond the table")
    kind = 0 if len(locations) < 1 << 16 else 1
    raw = np.ascontiguousarray(matrix, DTYPES[kind]).tobytes()
    try:
        import zstandard

        codec, body = ZSTD, zstandard.ZstdCompressor(level=level).compress(raw)
    except ImportError:
        codec, body = GZIP, gzip.compress(raw, mtime=0)
    out = io.BytesIO()
    out.write(struct.pack(HEADER, MAGIC, DENSE, kind, MINUTE_MAJOR, codec, t, n, len(locations), homes))
    out.write(np.asarray(minutes, "<u4").tobytes())
    for table in (people, locations):
        text = "\n".join(table).encode()
        out.write(struct.pack("<I", len(text)))
        out.write(text)
    out.write(struct.pack("<QQ", len(raw), len(body)))
    out.write(body)
    return out.getvalue()


def unpack(buffer: bytes) -> tuple[np.ndarray, list[int], list[str], list[str], int]:
    """The parts of ``pack``; ``ValueError`` for anything that is not a whole buffer."""
    source = io.BytesIO(buffer)

    def take(n: int) -> bytes:
        got = source.read(n)
        if len(got) != n:
            raise ValueError("the buffer ends early")
        return got

    magic, layout, kind, orientation, codec, t, n, n_locations, homes = struct.unpack(HEADER, take(struct.calcsize(HEADER)))
    if magic != MAGIC:
        raise ValueError("not a movement matrix")
    if (layout, orientation) != (DENSE, MINUTE_MAJOR) or kind >= len(DTYPES):
        raise ValueError(f"unknown layout {layout}, orientation {orientation} or dtype {kind}")
    minutes = np.frombuffer(take(4 * t), "<u4").tolist()
    tables = []
    for want in (n, n_locations):
        text = take(*struct.unpack("<I", take(4))).decode()
        table = text.split("\n") if text else []
        if len(table) != want:
            raise ValueError(f"{len(table)} ids where the header tells of {want}")
        tables.append(table)
    size, packed = struct.unpack("<QQ", take(16))
    body = take(packed)
    if codec == ZSTD:
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
    elif codec == GZIP:
        body = gzip.decompress(body)
    if len(body) != size or size != t * n * np.dtype(DTYPES[kind]).itemsize:
        raise ValueError("the payload has another length than the header tells")
    return np.frombuffer(body, DTYPES[kind]).reshape(t, n), minutes, *tables, homes


def _order(ids: list[str]) -> list[str]:
    """Numbers by value, then other texts."""
    return sorted(set(ids), key=lambda x: (not x.isdigit(), int(x) if x.isdigit() else 0, x))


def encode(schedule: DataFrame) -> DataFrame:
    """``zone, buffer`` of ``zone, minute, person_id, is_home, location_id``; ``ValueError`` if a
    person is nowhere, or in two places, at some minute. A home and a place may share an id."""

    def run(table):
        zone = table["zone"][0]
        minute, person = table["minute"].to_pylist(), table["person_id"].to_pylist()
        place = list(zip(table["is_home"].to_pylist(), table["location_id"].to_pylist(), strict=True))
        minutes, people = sorted(set(minute)), _order(person)
        home = _order([x for is_home, x in place if is_home])
        away = _order([x for is_home, x in place if not is_home])
        at = {(True, x): i for i, x in enumerate(home)} | {(False, x): len(home) + i for i, x in enumerate(away)}
        row, col = {m: i for i, m in enumerate(minutes)}, {p: i for i, p in enumerate(people)}
        matrix = np.full((len(minutes), len(people)), -1, np.int64)
        if len(minute) != matrix.size:
            raise ValueError(f"{len(minute)} rows for {len(minutes)} minutes and {len(people)} people")
        matrix[[row[m] for m in minute], [col[p] for p in person]] = [at[x] for x in place]
        if (matrix < 0).any():
            raise ValueError("a person without a place")
        return pa.table([pa.array([zone.as_py()]), pa.array([pack(matrix, minutes, people, home + away, len(home))], pa.binary())], ["zone", "buffer"])

    return schedule.groupBy("zone").applyInArrow(run, "zone string, buffer binary")


def decode(buffers: DataFrame) -> DataFrame:
    """The schedule rows of ``zone, buffer``."""

    def run(batches):
        for batch in batches:
            for zone, buffer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix, minutes, people, locations, homes = unpack(buffer)
                names = pa.array(locations, pa.string())
                for minute, row in zip(minutes, matrix, strict=True):
                    at = pa.array(row.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([zone] * len(row), pa.string()), pa.array(np.full(len(row), minute, np.int32)), pa.array(people, pa.string()), pa.array(row < homes), names.take(at)], ["zone", "minute", "person_id", "is_home", "location_id"])

    return buffers.select("zone", "buffer").mapInArrow(run, f"zone string, {SCHEDULE}")


def read(spark, path: str) -> DataFrame:
    """The schedules of the buffers below a path, the file's name being the zone."""
    files = spark.read.format("binaryFile").load(path)
    return decode(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("zone"), F.col("content").alias("buffer")))
