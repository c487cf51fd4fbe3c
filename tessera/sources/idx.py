"""IDX files of images and labels."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The numbers that begin the two kinds of files.
IMAGES, LABELS = 2051, 2049
NAMES = {"train": ("train-images-idx3-ubyte", "train-labels-idx1-ubyte"), "test": ("t10k-images-idx3-ubyte", "t10k-labels-idx1-ubyte")}


def decode_images(data: bytes) -> np.ndarray:
    """(image, row, column) pixels; an error on another magic number or size."""
    magic, n, rows, cols = struct.unpack(">4I", data[:16])
    if magic != IMAGES or len(data) != 16 + n * rows * cols:
        raise ValueError("not an IDX file of images")
    return np.frombuffer(data, np.uint8, offset=16).reshape(n, rows, cols)


def decode_labels(data: bytes) -> np.ndarray:
    magic, n = struct.unpack(">2I", data[:8])
    if magic != LABELS or len(data) != 8 + n:
        raise ValueError("not an IDX file of labels")
    return np.frombuffer(data, np.uint8, offset=8)


def read_images(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """(id, v): pixels of each image row by row, numbered from 0."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                images = decode_images(data)
                for k in range(0, len(images), rows):
                    part = images[k : k + rows].reshape(len(images[k : k + rows]), -1).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part))), pa.array(part.tolist(), pa.list_(pa.float64()))], ["id", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, v array<double>")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label)."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                labels = decode_labels(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(labels))), pa.array(labels.astype(np.int32))], ["id", "label"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, label int")


def read_pair(spark: SparkSession, folder: str, part: str = "train") -> DataFrame:
    """(id, label, v) of the images and labels under their public names."""
    images, labels = NAMES[part]
    return read_images(spark, f"{folder}/{images}").join(read_labels(spark, f"{folder}/{labels}"), "id").select("id", "label", "v")


def read_both(spark: SparkSession, folder: str) -> DataFrame:
    """Training and test images, the latter numbered on."""
    from pyspark.sql import functions as F

    a, b = read_pair(spark, folder, "train"), read_pair(spark, folder, "test")
    n = a.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("n"))
    return a.unionByName(b.join(F.broadcast(n), how="cross").select((F.col("id") + F.col("n")).alias("id"), "label", "v"))
