"""Media files: discovery, content-addressed storage, local descriptors.

Extractors take a file's bytes and return a matrix of local descriptors.  Those
below need numpy only: oriented-gradient patches for images (PNG, PGM, PPM) and
cepstra or spectra for WAV audio; others can be registered.  A file that
no extractor can read gets an error instead of made-up vectors.
"""

from __future__ import annotations

import io
import struct
import time
import uuid
import wave
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.types import QuarryError

Extractor = Callable[[bytes], np.ndarray]
_EXTRACTORS: dict[tuple[str, str], Extractor] = {}


def register_extractor(media: str, method: str, extract: Extractor) -> None:
    _EXTRACTORS[media.lower(), method.lower()] = extract


def extractor(media: str, method: str) -> Extractor:
    media, method = media.lower(), method.lower()
    if media not in {m for m, _ in _EXTRACTORS}:
        raise QuarryError(f"no extractor for {media}")
    if media == "audio":  # other audio methods stand for the usual one
        return _EXTRACTORS.get((media, method)) or _EXTRACTORS[media, "mfcc"]
    if (media, method) not in _EXTRACTORS:
        raise QuarryError(f"no {method} extractor for {media} is registered")
    return _EXTRACTORS[media, method]


def find_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """path, length, content of all files below folder, of the given extensions in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(F.lower(F.substring_index("path", ".", -1)).isin(*[e.lower().lstrip(".") for e in extensions])) if extensions else files


def store(files: DataFrame) -> DataFrame:
    """path, md5, stored_name (md5 and extension) of each file; equal contents share a name."""
    name = F.substring_index("path", "/", -1)
    ext = F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    return files.select("path", F.md5("content").alias("md5"), F.concat(F.md5("content"), ext).alias("stored_name"), "length")


class MediaStore:
    """Contents by name (md5 and extension) in Parquet below root; equal contents are kept once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        """stored_name, content, length."""
        schema = "stored_name string, content binary, length long"
        if not self._fs.exists(self._path(self.root)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(self.root)

    def put(self, files: DataFrame) -> DataFrame:
        """Adds what isn't there; path and stored_name of each of files (path, content, length)."""
        named = files.join(store(files).select("path", "stored_name"), "path")
        new = named.join(self.read().select("stored_name"), "stored_name", "left_anti")
        first = new.groupBy("stored_name").agg(F.min("path").alias("path"))
        new.join(first, ["stored_name", "path"], "left_semi").dropDuplicates(["stored_name", "path"]).select("stored_name", "content", "length").write.parquet(f"{self.root}/{uuid.uuid4().hex}")
        return named.select("path", "stored_name")

    def exists(self, name: str) -> bool:
        return self.read().filter(F.col("stored_name") == name).limit(1).count() > 0

    def remove(self, name: str) -> bool:
        """Whether it was there.  Files that hold it are written anew without it before they go."""
        where = self.read().filter(F.col("stored_name") == name).select(F.input_file_name().alias("f")).distinct().collect()
        for r in where:  # equal contents are kept once: one file
            rest = self.spark.read.schema("stored_name string, content binary, length long").parquet(r["f"]).filter(F.col("stored_name") != name)
            rest.write.parquet(f"{self.root}/{uuid.uuid4().hex}")
            self._fs.delete(self._path(r["f"]), False)
        return bool(where)

    def stats(self) -> DataFrame:
        return storage_stats(self.read())


def storage_stats(stored: DataFrame) -> DataFrame:
    one = stored.groupBy("stored_name").agg(F.first("length").alias("length"))
    return one.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_size"))


def descriptors(files: DataFrame, media: str, method: str) -> DataFrame:
    """path, descriptor (one row each), extract_error (with a null descriptor) of each file."""
    extract = extractor(media, method)

    def made(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(path, d.astype(float).tolist(), None) for d in extract(bytes(content))]
                except Exception as e:  # a file's fault is the file's result
                    rows = [(path, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "descriptor", "extract_error"])

    return files.select("path", "content").mapInPandas(made, "path string, descriptor array<double>, extract_error string")


def _png(data: bytes) -> np.ndarray:
    """Grey levels of a PNG of eight bits a channel that isn't interlaced."""
    at, packed, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, woven = struct.unpack(">IIBBBBB", body)
            if depth != 8 or woven:
                raise ValueError("only PNG of eight bits a channel that isn't interlaced can be read")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * planes)
    rows, above = np.zeros((h, w, planes), np.uint8), np.zeros((w, planes), np.int64)
    for y in range(h):
        how, line = raw[y, 0], raw[y, 1:].reshape(w, planes).astype(np.int64)
        if how == 1:
            line = np.cumsum(line, axis=0)
        elif how == 2:
            line = line + above
        elif how in (3, 4):
            line = line.copy()
            left, corner = np.zeros(planes, np.int64), np.zeros(planes, np.int64)
            for x in range(w):
                if how == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                left, corner = (line[x] + guess) % 256, above[x]
                line[x] = left
        above = line % 256
        rows[y] = above
    if palette is not None:
        return palette[rows[:, :, 0]].astype(float).mean(axis=2)
    return rows[:, :, : planes - (planes in (2, 4))].astype(float).mean(axis=2)


def read_image(data: bytes) -> np.ndarray:
    """Grey levels of a PNG, or a binary PGM or PPM."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while data[end : end + 1] not in (b"", b" ", b"\n", b"\t", b"\r"):
            end += 1
        if data[at:end].startswith(b"#"):
            end = data.index(b"\n", at)
        elif end > at:
            fields.append(data[at:end])
        at = end + 1
        if at > len(data):
            raise ValueError("not an image that can be read")
    if fields[0] not in (b"P5", b"P6"):
        raise ValueError("not a binary PGM or PPM")
    w, h, planes = int(fields[1]), int(fields[2]), 3 if fields[0] == b"P6" else 1
    return np.frombuffer(data[at : at + w * h * planes], np.uint8).reshape(h, w, planes).astype(float).mean(axis=2)


def gradient_patches(data: bytes, patch: int = 16) -> np.ndarray:
    """128 values for each patch: eight gradient directions in four by four cells, normalised."""
    grey = read_image(data)
    grey = np.pad(grey, [(0, -grey.shape[0] % patch), (0, -grey.shape[1] % patch)], mode="edge")
    gy, gx = np.gradient(grey)
    size, turn = np.hypot(gx, gy), ((np.arctan2(gy, gx) / (2 * np.pi)) % 1 * 8).astype(int) % 8
    cell = patch // 4
    votes = np.stack([np.where(turn == k, size, 0) for k in range(8)], axis=-1)
    h, w = grey.shape
    cells = votes.reshape(h // cell, cell, w // cell, cell, 8).sum(axis=(1, 3))
    out = cells.reshape(h // patch, 4, w // patch, 4, 8).transpose(0, 2, 1, 3, 4).reshape(-1, 128)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _frames(data: bytes, size: int = 1024, hop: int = 512, want: int = 22050) -> tuple[np.ndarray, int]:
    """Windows of the sound at ``want`` samples a second, and that rate."""
    with wave.open(io.BytesIO(data)) as f:
        kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[f.getsampwidth()]
        x = np.frombuffer(f.readframes(f.getnframes()), kind).astype(float).reshape(-1, f.getnchannels()).mean(axis=1)
        rate = f.getframerate()
    x = (x - 128) / 128 if kind is np.uint8 else x / float(np.iinfo(kind).max)
    if rate != want and len(x):
        x = np.interp(np.arange(0, len(x) / rate, 1 / want), np.arange(len(x)) / rate, x)
        rate = want
    x = np.pad(x, (0, max(0, size - len(x))))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop], rate


def _hundred(rows: np.ndarray, n: int = 100) -> np.ndarray:
    """n rows: evenly picked, or the last repeated."""
    if len(rows) >= n:
        return rows[np.linspace(0, len(rows) - 1, n).astype(int)]
    return np.concatenate([rows, np.repeat(rows[-1:], n - len(rows), axis=0)])


def _spectral(frames: np.ndarray, power: np.ndarray, rate: int) -> np.ndarray:
    """Centroid, bandwidth, rolloff, zero crossings and loudness of each frame."""
    f = np.linspace(0, rate / 2, power.shape[1])
    total = np.maximum(power.sum(axis=1), 1e-12)
    centre = power @ f / total
    width = np.sqrt((power * (f - centre[:, None]) ** 2).sum(axis=1) / total)
    roll = f[(np.cumsum(power, axis=1) >= 0.85 * total[:, None]).argmax(axis=1)]
    cross = (np.diff(np.signbit(frames), axis=1) != 0).mean(axis=1)
    return np.stack([centre, width, roll, cross, np.sqrt((frames**2).mean(axis=1))], axis=1)


def mfcc(data: bytes, count: int = 13, bands: int = 40) -> np.ndarray:
    """100 rows of 13 cepstra and 7 spectral values."""
    frames, rate = _frames(data)
    power = np.abs(np.fft.rfft(frames * np.hanning(frames.shape[1]), axis=1)) ** 2
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 1400), bands + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.linspace(0, rate / 2, power.shape[1])
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    log = np.log(np.maximum(power @ np.clip(np.minimum(up, down), 0, None).T, 1e-10))
    basis = np.cos(np.pi / bands * (np.arange(bands) + 0.5)[:, None] * np.arange(count))
    extra = _spectral(frames, power, rate)
    more = np.stack([power.max(axis=1), np.exp(np.log(power + 1e-10).mean(axis=1)) / (power.mean(axis=1) + 1e-10)], axis=1)
    return _hundred(np.concatenate([log @ basis, extra, more], axis=1))


def spectral(data: bytes) -> np.ndarray:
    """100 rows of the five spectral values, four times each."""
    frames, rate = _frames(data)
    power = np.abs(np.fft.rfft(frames * np.hanning(frames.shape[1]), axis=1)) ** 2
    return _hundred(np.tile(_spectral(frames, power, rate), (1, 4)))


def single_vector(data: bytes) -> np.ndarray:
    """The mean of mfcc(), a hundred times."""
    return np.repeat(mfcc(data).mean(axis=0, keepdims=True), 100, axis=0)


def speed(data: bytes) -> dict[str, float]:
    """Seconds that local descriptors and the single vector of a sound take."""
    out = {}
    for name, extract in (("local", mfcc), ("single", single_vector)):
        began = time.perf_counter()
        extract(data)
        out[name] = time.perf_counter() - began
    return out


register_extractor("audio", "single", single_vector)
register_extractor("image", "sift", gradient_patches)
register_extractor("audio", "mfcc", mfcc)
register_extractor("audio", "spectral", spectral)
