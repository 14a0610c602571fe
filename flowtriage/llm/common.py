"""What the training-data operators share.

Rules that hold for all of them: a null text counts as an empty one, results
replace input columns of the same name, rows are never dropped or capped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Private name of the text column handed to Python tasks.
TEXT = "_op_text"
#: The letters and digits of a plain word; everything in ASCII but these parts words.
PLAIN_BYTES = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if byte >= 0x80 or 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A else 32
    for byte in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: Bytes of a text that are taken apart at a time; bounds what a very long text needs beside itself.
SLICE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def slices(text: bytes, size: int = SLICE, cut: re.Pattern = _SPACE) -> Iterator[bytes]:
    """Parts that make up the text, long ones cut where ``cut`` matches (white space goes to the later part)."""
    at = 0
    while len(text) - at > size:
        place = cut.search(text, at + size)
        if not place:
            break
        yield text[at : place.start()]
        at = place.start()
    yield text[at:] if at else text


def plain_words(text: bytes) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased, other scripts left as they are."""
    return text.translate(PLAIN_BYTES).split()


def plain_word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The plain words of a text, those of one slice at a time."""
    for part in slices(text.translate(PLAIN_BYTES)):
        yield part.split()


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns of df that are not about to be replaced, compared as Spark compares names."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list[bytes]], list[Sequence]]],
) -> DataFrame:
    """Arrow batches of whole UTF-8 texts through one function per task.

    ``make`` runs once in each task and returns the function; that gets the
    texts of a batch (null as empty) and returns one sequence per field. Input
    columns named in ``keep`` pass through untouched. No shuffle.
    """
    kept = [c for c in keep if c.lower() not in {f.name.lower() for f in fields}]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = work(batch.column(len(kept)).cast(pa.binary()).to_pylist())
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(values, type=kind) for values, kind in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*kept, text_or_empty(text).alias(TEXT)).mapInArrow(run, schema)
