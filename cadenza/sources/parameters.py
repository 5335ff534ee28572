"""Binary model parameter files: a text header, a byte order mark, dimensions and 32-bit values.

Readers give one row a vector; writers give the bytes of one file; printing is text with fixed digits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import files

#: Fixed values of the format.
MAGIC, HEADER = 0x11223344, b"s3\nversion 1.0\nendhdr\n"


def _body(content: bytes) -> tuple[dict[str, str], str, int]:
    """The attributes of the header, the byte order, and where the dimensions begin."""
    if not content.startswith(b"s3\n"):
        raise ValueError("not a parameter file")
    end = content.index(b"endhdr\n")
    pairs = [line.split(None, 1) for line in content[3:end].decode("ascii").splitlines() if line.strip()]
    attributes = {p[0]: (p[1].strip() if len(p) > 1 else "") for p in pairs if not p[0].startswith("#")}
    at = end + len(b"endhdr\n")
    for order in "<>":
        if struct.unpack_from(order + "I", content, at)[0] == MAGIC:
            return attributes, order, at + 4
    raise ValueError("no byte order mark")


def decode_arrays(content: bytes, dims: int) -> np.ndarray:
    """An array of one to three dimensions; for one, its length is the count of values."""
    _, order, at = _body(content)
    shape = struct.unpack_from(f"{order}{dims}I", content, at) if dims > 1 else ()
    at += 4 * len(shape)
    n = struct.unpack_from(order + "I", content, at)[0]
    x = np.frombuffer(content, order + "f4", n, at + 4).astype(float)
    if shape and int(np.prod(shape)) != n:
        raise ValueError(f"{n} values for the dimensions {shape}")
    return x.reshape(shape or (n,))


def decode_gaussians(content: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Codebook, stream, density and vector of a file of means or variances; streams may differ in length."""
    _, order, at = _body(content)
    books, streams, densities = struct.unpack_from(order + "3I", content, at)
    lengths = struct.unpack_from(f"{order}{streams}I", content, at + 12)
    at += 12 + 4 * streams
    n = struct.unpack_from(order + "I", content, at)[0]
    if n != books * densities * sum(lengths):
        raise ValueError(f"{n} values for {books} codebooks of {densities} densities")
    x, r = np.frombuffer(content, order + "f4", n, at + 4).astype(float), 0
    for i in range(books):
        for j, size in enumerate(lengths):
            for k in range(densities):
                yield i, j, k, x[r : r + size]
                r += size


def gaussians(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, cb, stream, density, vec of files of means or variances."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in batch.itertuples(index=False):
                yield pd.DataFrame([(p, *r) for r in decode_gaussians(c)], columns=["path", "cb", "stream", "density", "vec"])

    return files(spark, path, pattern).mapInPandas(run, "path string, cb int, stream int, density int, vec array<double>")


def matrices(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, i, j, vec of files of three dimensions: weights (senone, stream, density) or transitions (matrix, from, to)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in batch.itertuples(index=False):
                x = decode_arrays(c, 3)
                yield pd.DataFrame([(p, i, j, row) for i, part in enumerate(x) for j, row in enumerate(part)], columns=["path", "i", "j", "vec"])

    return files(spark, path, pattern).mapInPandas(run, "path string, i int, j int, vec array<double>")


def values(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, vec of files of one dimension, as interpolation weights are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, decode_arrays(c, 1)) for p, c in batch.itertuples(index=False)], columns=["path", "vec"])

    return files(spark, path, pattern).mapInPandas(run, "path string, vec array<double>")


def encode_gaussians(rows: list[tuple[int, int, int, list[float]]]) -> bytes:
    """The bytes of a file of rows (cb, stream, density, vec), complete and in any order."""
    rows = sorted(rows, key=lambda r: r[:3])
    books, streams, densities = (1 + max(r[n] for r in rows) for n in range(3))
    lengths = [len(r[3]) for r in rows if r[0] == 0 and r[2] == 0]
    if len(rows) != books * streams * densities:
        raise ValueError("rows are missing or repeated")
    x = np.concatenate([np.asarray(r[3], "<f4") for r in rows])
    return HEADER + struct.pack(f"<4I{streams}II", MAGIC, books, streams, densities, *lengths, len(x)) + x.tobytes()


def encode_matrices(x: np.ndarray) -> bytes:
    """The bytes of a file of three dimensions, or of one."""
    shape = x.shape if x.ndim == 3 else ()
    return HEADER + struct.pack(f"<I{len(shape)}II", MAGIC, *shape, x.size) + x.astype("<f4").tobytes()


def gaussian_files(model: DataFrame, key: str) -> DataFrame:
    """key, content: one file for each key from rows (key, cb, stream, density, vec)."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        rows = list(part[["cb", "stream", "density", "vec"]].itertuples(index=False, name=None))
        return pd.DataFrame({key: [part[key].iloc[0]], "content": [encode_gaussians(rows)]})

    kind = model.schema[key].dataType.simpleString()
    return model.select(key, "cb", "stream", "density", "vec").groupBy(key).applyInPandas(pack, f"{key} {kind}, content binary")


def printed(vec: Column, digits: int = 6, normalise: bool = False) -> Column:
    """The numbers of an array with so many significant digits, a blank after each; normalised they sum to 1 first."""
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)
    x = F.when((total > 0) & F.lit(normalise), F.transform(vec, lambda v: v / total)).otherwise(vec)
    return F.concat(F.array_join(F.transform(x, lambda v: F.format_string(f"%.{digits - 1}e", v)), " "), F.lit(" "))


def printed_gaussians(model: DataFrame, digits: int = 6) -> DataFrame:
    """cb, stream, density, line of rows (cb, stream, density, vec)."""
    return model.select("cb", "stream", "density", F.concat(F.format_string("density %4d ", F.col("density")), printed(F.col("vec"), digits)).alias("line"))
