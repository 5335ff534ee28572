"""Binary sources and sinks: audio and feature files through Spark's binaryFile reader."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of every file below path."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return read.load(path).select("path", "content")


def kind_of(content: Column, path: Column) -> Column:
    """wav, sphere, s3, mfc or raw, from the first bytes; mfc when the count matches the length."""
    head = F.substring(content, 1, 4)
    count = F.conv(F.hex(head), 16, 10).cast("long")
    swapped = F.conv(F.concat(*[F.hex(F.substring(content, n, 1)) for n in (4, 3, 2, 1)]), 16, 10).cast("long")
    floats = (F.length(content) - 4) / 4
    return (
        F.when(head == F.lit(b"RIFF"), "wav").when(head == F.lit(b"NIST"), "sphere").when(F.substring(content, 1, 2) == F.lit(b"s3"), "s3")
        .when((count == floats) | (swapped == floats), "mfc").when(path.rlike(r"\.(raw|sph)$"), "raw").otherwise("unknown")
    )


def decode_wav(content: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and 16-bit mono samples (channels averaged, 8 bits widened) of a RIFF file."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("a WAV file without format or data")
    _, channels, rate, _, _, bits = form
    if bits == 16:
        x = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int32)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.int32) - 128) * 256
    else:
        raise ValueError(f"{bits} bits a sample")
    if channels > 1:
        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1).astype(np.int32)
    return rate, channels, x.astype(np.int16)


def audio(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, channels, samples of every WAV file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *decode_wav(c)) for p, c in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "samples"])

    return files(spark, path, "*.wav").mapInPandas(run, "path string, rate int, channels int, samples array<short>")


def decode_features(content: bytes, width: int) -> np.ndarray:
    """Frames (n, width) of a feature file: a count and as many 32-bit floats, in either byte order."""
    for order in ("<", ">"):
        if len(content) >= 4 and struct.unpack_from(order + "i", content)[0] == (len(content) - 4) // 4:
            x = np.frombuffer(content[4:], order + "f4")
            if len(x) % width:
                raise ValueError(f"{len(x)} values are no frames of {width}")
            return x.reshape(-1, width)
    raise ValueError("the count doesn't match the file's length")


def features(spark: SparkSession, path: str, width: int = 13, first: int | None = None, last: int | None = None) -> DataFrame:
    """path, frame, vec of every feature file, or of the frames first to last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in batch.itertuples(index=False):
                x = decode_features(c, width)
                a, b = first or 0, len(x) if last is None else last + 1
                yield pd.DataFrame({"path": p, "frame": np.arange(len(x), dtype=np.int32)[a:b], "vec": list(x[a:b].astype(float))})

    return files(spark, path, "*.mfc").mapInPandas(run, "path string, frame int, vec array<double>")


def encode_features(frames: DataFrame, key: str) -> DataFrame:
    """key, content: the bytes of one feature file for each key, from rows (key, frame, vec)."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows.sort_values("frame")["vec"].tolist(), dtype="<f4")
        return pd.DataFrame({key: [rows[key].iloc[0]], "content": [struct.pack("<i", x.size) + x.tobytes()]})

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "frame", "vec").groupBy(key).applyInPandas(pack, f"{key} {kind}, content binary")


def quantised_weights(weights: Column, base: float = 1.0001, shift: int = 10) -> Column:
    """Each weight as a byte: minus its logarithm in base, shifted, at most 255."""
    log = lambda p: F.round(-F.log(F.greatest(p, F.lit(1e-300))) / float(np.log(base)) / (1 << shift))
    return F.transform(weights, lambda p: F.least(log(p), F.lit(255.0)).cast("int"))
