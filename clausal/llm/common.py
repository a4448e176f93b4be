"""Shared helpers of the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausal.plans.shared import dropped, shared_dir, written

#: A word is a run of characters other than these six ASCII separators.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are handed to the vectorised kernels in slices of about so many characters.
SLICE_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named input table, pruned to the given columns where any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer referred to; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into slices of about `chars` characters, so that kernels stay within bounded memory."""
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names made from the given ones that docs doesn't have, whatever the case."""
    have, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while (n := f"_{n}").lower() in have:
            pass
        have.add(n.lower())
        out.append(n)
    return out


def held_keys(rows: DataFrame, key: F.Column, most: int = 28) -> tuple[DataFrame, int]:
    """A bitmap of the keys of rows, in rows of 4 KiB, and its number of bits: about 16 a key, but 2**most (32 MiB) at most."""
    bits = 1 << min(most, max(20, (16 * rows.count()).bit_length()))
    spot = F.pmod(key, F.lit(bits))
    return rows.groupBy(F.bitmap_bucket_number(spot).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bitmap")), bits


def marked(docs: DataFrame, key: F.Column, held: tuple[DataFrame, int], name: str) -> DataFrame:
    """docs with a column that is true where the bitmap may hold the key, and always where it does; the bitmap goes to all tasks, docs stay where they are."""
    chunk, at, bitmap = unused(docs, "chunk", "at", "bitmap")
    spot = F.pmod(key, F.lit(held[1]))
    spread = docs.withColumns({chunk: F.bitmap_bucket_number(spot), at: F.bitmap_bit_position(spot)}).join(F.broadcast(held[0].toDF(chunk, bitmap)), chunk, "left")
    bit = F.expr(f"shiftright(cast(conv(hex(substring(`{bitmap}`, cast(`{at}` div 8 as int) + 1, 1)), 16, 10) as int), cast(`{at}` % 8 as int)) & 1 = 1")
    return spread.withColumn(name, F.coalesce(bit, F.lit(False))).drop(chunk, at, bitmap)


def text_key(column: str = "text") -> F.Column:
    """A 64-bit key of a text that tells apart rows which share an id; null has its own."""
    return F.xxhash64(F.col(column), F.col(column).isNull())


__all__ = ["SLICE_CHARS", "WORD", "dropped", "held_keys", "marked", "released", "shared_dir", "slices", "table", "text_key", "unused", "written"]
