"""What the text operators share: reading a table, session settings, free column names, word splitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from foliant.session import SETTINGS, new_folder

#: Bounds on what a Python worker holds at once, whatever the length of the texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def prepared(spark: SparkSession) -> SparkSession:
    """Apply the settings the text operators rely on."""
    for key, value in (SETTINGS | BATCHES).items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder whose few, large rows are written and read back a few megabytes at a time."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "1").option("parquet.block.size", str(16 << 20)).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever extra columns came along."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: UTF-8 bytes after lower-casing A-Z: digits, letters and all bytes of other characters stay, the rest separates words.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose letters A-Z are lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def encoded_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space of many texts: number by text, code of each word, and the distinct words."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.large_string())))
    counts = np.diff(lists.offsets.to_numpy())
    words = lists.flatten()
    real = pc.not_equal(words, "")
    if pc.all(real).as_py() is False:  # a blank text gives one empty word
        owner = np.repeat(np.arange(len(texts)), counts)[real.to_numpy(zero_copy_only=False)]
        counts, words = np.bincount(owner, minlength=len(texts)), words.filter(real)
    coded = words.dictionary_encode()
    return counts.astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same on every machine."""
    import pandas as pd

    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.empty(0, np.uint64)
