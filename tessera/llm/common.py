"""Helpers shared by the operators: Arrow batches in bounded slices, words, tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more of the six ASCII white space characters, as a Java and RE2 pattern.
WS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str = "doc_id", mod: int = 5):
    """crc32 of the id as text, mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores until no column has it in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, text_index: int = 1, most_bytes: int = 4 << 20):
    """Sub-batches of about most_bytes of text (one long text may exceed it alone)."""
    col = batch.column(text_index)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most_bytes or i + 1 == len(sizes):
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0


def texts_of(batch: pa.RecordBatch, index: int = 1) -> list[str]:
    """The texts of a column, null as the empty text."""
    return [t or "" for t in batch.column(index).to_pylist()]


def bytes_of(batch: pa.RecordBatch, index: int = 1) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [t or b"" for t in batch.column(index).cast(pa.binary()).to_pylist()]


class Generations:
    """A cache of bounded size: a full young generation replaces the old one."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Keys found in neither generation; those of the old one become young again."""
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        out, young, old = [], self.young, self.old
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out
