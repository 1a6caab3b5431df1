"""miniSEED 2 as a data source: spark.read.format("miniseed").load(path), and df.write.format("miniseed").save(path).

A file is a run of records of one length, a power of two. Reading is split at record boundaries, so a large file is read by many tasks; each
record gives one row, a contiguous packet. Encodings: 16- and 32-bit integers, floats, doubles, Steim-1 and Steim-2 (differences of 4 to
32 bits in frames of 64 bytes, unpacked by NumPy for a record at a time). Writing packs each row into as many records as it needs: Steim-2 where
all values are whole numbers whose differences have at most 30 bits, else doubles. Paths are those of pyarrow file systems, which tasks open themselves.

Rows: network, station, location, channel, startt (seconds since 1970, to 0.1 ms), samprate (Hz), nsamp, data. A damaged record is an error.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "network string, station string, location string, channel string, startt double, samprate double, nsamp int, data array<double>"
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
HEADER = struct.Struct(">6scc5s2s3s2sHHBBBxHHhhBBBBiHH")
PLAIN = {1: ">i2", 3: ">i4", 4: ">f4", 5: ">f8"}
#: fixed values: how a word of a Steim frame is cut, by its code and (Steim-2) its two leading bits: number of differences and bits of each
CUTS = {10: {(1, None): (4, 8), (2, None): (2, 16), (3, None): (1, 32)}, 11: {(1, None): (4, 8), (2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)}}
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def unpacked(frames: bytes, n: int, encoding: int) -> np.ndarray:
    """n samples of Steim frames."""
    words = np.frombuffer(frames, ">u4").astype(np.int64).reshape(-1, 16)
    codes = (words[:, :1] >> (30 - 2 * np.arange(16))) & 3
    codes[0, 1:3] = 0  # the first and the last sample
    codes, flat = codes.ravel(), words.ravel()
    out, held = np.zeros((len(flat), 7), np.int64), np.zeros((len(flat), 7), bool)
    for (code, lead), (count, bits) in CUTS[encoding].items():
        at = np.nonzero((codes == code) if lead is None else (codes == code) & (flat >> 30 == lead))[0]
        values = (flat[at, None] >> (bits * np.arange(count - 1, -1, -1))) & ((1 << bits) - 1)
        out[at, :count], held[at, :count] = np.where(values >> (bits - 1), values - (1 << bits), values), True
    steps = out[held][:n]
    if len(steps) < n:
        raise ValueError("a record holds fewer samples than it says")
    steps[0] = np.int64(words[0, 1]) - (1 << 32 if words[0, 1] >> 31 else 0)
    values = np.cumsum(steps)
    if (int(values[-1]) - int(words[0, 2])) & 0xFFFFFFFF:
        raise ValueError("a record's samples don't end in its last value")
    return values


def packed(values: np.ndarray, before: int, most_frames: int) -> tuple[bytes, int]:
    """Steim-2 frames of as many samples as fit in most_frames, and their number."""
    steps = np.diff(values, prepend=before)
    frames, done = [], 0
    cuts = sorted(((count, bits, code, lead) for (code, lead), (count, bits) in CUTS[11].items()), reverse=True)
    while done < len(steps) and len(frames) < most_frames:
        frame, control = [], 0
        if not frames:
            frame, control = [0, 0], 0
        while len(frame) < 15 and done < len(steps):
            for count, bits, code, lead in cuts:
                part = steps[done : done + count]
                if len(part) == count and part.min() >= -(1 << (bits - 1)) and part.max() < 1 << (bits - 1):
                    word = sum((int(v) & ((1 << bits) - 1)) << (bits * (count - 1 - k)) for k, v in enumerate(part)) | ((lead or 0) << 30)
                    control |= code << (30 - 2 * (len(frame) + 1))
                    frame.append(word)
                    done += count
                    break
            else:
                raise ValueError("a difference has more than 30 bits")
        frames.append([control, *frame, *[0] * (15 - len(frame))])
    if frames:
        frames[0][1:3] = [int(values[0]) & 0xFFFFFFFF, int(values[done - 1]) & 0xFFFFFFFF]
    return np.array(frames, np.uint64).astype(">u4").tobytes(), done


def rate_fields(rate: float) -> tuple[int, int]:
    """Rate factor and multiplier: samples a second, or seconds a sample as a negative number."""
    for value, sign in ((rate, 1), (1 / rate, -1)):
        if value >= 1 and abs(value - round(value)) < 1e-9 * value and round(value) <= 32767:
            return sign * round(value), 1
    for multiplier in range(2, 32768):
        if abs(rate * multiplier - round(rate * multiplier)) < 1e-9 * rate * multiplier and 1 <= round(rate * multiplier) <= 32767:
            return round(rate * multiplier), -multiplier
    raise ValueError(f"a rate of {rate} Hz has no exact form in a record")


def rate_of(factor: int, multiplier: int) -> float:
    base = float(factor) if factor > 0 else -1.0 / factor if factor else 0.0
    return base * multiplier if multiplier > 0 else base / -multiplier


def records(row: Sequence, length: int, first: int) -> Iterator[bytes]:
    """The records of one row, numbered from `first`."""
    network, station, location, channel, startt, rate, _, data = row
    values = np.array(data, float)
    if np.isnan(values).any():
        raise ValueError("a packet with gaps must be split before it is written")
    whole = len(values) > 0 and bool((values == np.rint(values)).all()) and np.abs(values).max() < 1 << 31 and np.abs(np.diff(values)).max(initial=0) < 1 << 29
    factor, multiplier = rate_fields(rate)
    done, number = 0, first
    code = lambda text, n: (text or "").encode("ascii").ljust(n)
    for text, n in ((network, 2), (station, 5), (location, 2), (channel, 3)):
        if len(text or "") > n:
            raise ValueError(f"code {text} is longer than {n} characters")
    while done < len(values):
        if whole:
            # the first difference of a record is not needed to read it
            body, n = packed(values[done:].astype(np.int64), int(values[done]), (length - 64) // 64)
        else:
            n = min(len(values) - done, (length - 64) // 8)
            body = values[done : done + n].astype(">f8").tobytes()
        ticks = round((startt + done / rate) * 10_000)
        at = EPOCH + timedelta(seconds=ticks // 10_000)
        head = HEADER.pack(b"%06d" % (number % 1_000_000), b"D", b" ", code(station, 5), code(location, 2), code(channel, 3), code(network, 2), at.year, at.timetuple().tm_yday, at.hour, at.minute, at.second, ticks % 10_000, n, factor, multiplier, 0, 0, 0, 1, 0, 64, 48)
        more = struct.pack(">HHBBBB", 1000, 0, 11 if whole else 5, 1, length.bit_length() - 1, 0)
        yield (head + more).ljust(64, b"\0") + body.ljust(length - 64, b"\0")
        done, number = done + n, number + 1


def record_length(head: bytes) -> tuple[int, int]:
    """Length of a record and encoding, from its blockette 1000."""
    at = struct.unpack_from(">H", head, 46)[0]
    for _ in range(head[39]):
        kind, following = struct.unpack_from(">HH", head, at)
        if kind == 1000:
            encoding, order, power = head[at + 4], head[at + 5], head[at + 6]
            if order != 1:
                raise ValueError("only records of big-endian byte order are read")
            return 1 << power, encoding
        at = following
    raise ValueError("a record without blockette 1000")


def decoded(record: bytes) -> tuple:
    """One row of a record."""
    _, _, _, station, location, channel, network, year, day, hour, minute, second, fraction, n, factor, multiplier, activity, _, _, _, correction, begin, _ = HEADER.unpack_from(record)
    _, encoding = record_length(record)
    if encoding in PLAIN:
        values = np.frombuffer(record, PLAIN[encoding], n, begin).astype(float)
    elif encoding in CUTS:
        values = unpacked(record[begin : begin + (len(record) - begin) // 64 * 64], n, encoding).astype(float) if n else np.zeros(0)
    else:
        raise ValueError(f"encoding {encoding} is not read")
    ticks = int((datetime(year, 1, 1, hour, minute, second, tzinfo=UTC) - EPOCH + timedelta(days=day - 1)).total_seconds()) * 10_000 + fraction
    ticks += 0 if activity & 2 else correction  # bit 1: the correction is part of the time already
    text = lambda code: code.decode("ascii").strip()
    return text(network), text(station), text(location), text(channel), ticks / 10_000, rate_of(factor, multiplier), n, values


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class Split(InputPartition):
    path: str
    first: int
    size: int
    length: int

    def __init__(self, path: str, first: int, size: int, length: int):
        super().__init__(None)
        self.path, self.first, self.size, self.length = path, first, size, length


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split_bytes = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> Sequence[InputPartition]:
        files, path = opened(self.path)
        info = files.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [f for f in files.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out = []
        for f in sorted((f for f in found if f.size), key=lambda f: f.path):
            with files.open_input_file(f.path) as file:
                length, _ = record_length(file.read(256))
            if f.size % length:
                raise ValueError(f"{f.path} is not a whole number of records")
            step = max(1, self.split_bytes // length) * length
            out += [Split(f.path, first, min(step, f.size - first), length) for first in range(0, f.size, step)]
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        step = max(1, (1 << 20) // partition.length) * partition.length
        with files.open_input_file(partition.path) as file:
            file.seek(partition.first)
            for at in range(0, partition.size, step):
                block = file.read(min(step, partition.size - at))
                rows = [decoded(block[k : k + partition.length]) for k in range(0, len(block), partition.length)]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.string()] * 4 + [pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], NAMES)


@dataclass
class Written(WriterCommitMessage):
    name: str


class Writer(DataSourceWriter):
    """Each task writes one hidden file, which gets its name when all tasks are done; a task that runs again writes another one."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.length, self.overwrite = options["path"], int(options.get("recordLength", 4096)), overwrite
        if self.length < 256 or self.length & (self.length - 1):
            raise ValueError("recordLength must be a power of two, 256 at least")

    def write(self, rows: Iterator) -> Written:
        files, path = opened(self.path)
        files.create_dir(path)
        name, number = f"{uuid.uuid4().hex}.mseed", 0
        with files.open_output_stream(f"{path}/.{name}") as file:
            for row in rows:
                for record in records([row[c] for c in NAMES], self.length, number + 1):
                    file.write(record)
                    number += 1
        return Written(name if number else "")

    def commit(self, messages: list[Written | None]) -> None:
        files, path = opened(self.path)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(path)):
                if f.base_name.endswith(".mseed") and not f.base_name.startswith("."):
                    files.delete_file(f.path)
        for m in messages:
            if m is not None and m.name:
                files.move(f"{path}/.{m.name}", f"{path}/{m.name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Files of tasks that were not done, or had no rows."""
        files, path = opened(self.path)
        for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(".") and f.base_name.endswith(".mseed"):
                files.delete_file(f.path)


class MiniSeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "miniseed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MiniSeed)


def samples(packets: DataFrame, step_us: int) -> DataFrame:
    """id, idx, value, fold of packets on a grid of step_us; what no packet holds is missing."""
    named = packets.select(F.concat_ws(".", "network", "station", "location", "channel").alias("id"), F.round(F.col("startt") * 1_000_000 / step_us).cast("long").alias("start"), F.posexplode("data").alias("at", "value"))
    return named.select("id", (F.col("start") + F.col("at")).alias("idx"), "value", F.lit(1.0).alias("fold"))
