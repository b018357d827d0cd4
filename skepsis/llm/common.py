"""Reading, writing and Arrow helpers shared by the operators of this folder."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..operators.scale import join_small, materialize, scratch_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, most: int, *by: str) -> DataFrame:
    """At most `most` rows: those with the smallest hash of the columns `by`, ties in the order of these columns.

    Rows are first cut to a share of the hashes that holds a few more than asked for, so that tasks don't each
    send `most` rows to the driver.
    """
    total = df.count()
    h = F.xxhash64(*by)
    if total > most:
        df = df.filter(F.shiftrightunsigned(h, 11) < F.lit(int(min(1.0, (1.2 * most + 64) / total) * 2.0 ** 53)))
    return df.orderBy(h, *by).limit(most)


_CLEAR: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Registers what a module keeps in a worker between tasks."""
    _CLEAR[owner] = clear


def turn_to(owner: str) -> None:
    """In a worker, before an operator's work: what other operators have kept there goes, as their stage is over."""
    if _LAST != [owner]:
        for name, clear in _CLEAR.items():
            if name != owner:
                clear()
        _LAST[:] = [owner]
        pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short batches, so that what a task holds beside its input stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def record(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for f, c in ((f, cols[f.name]) for f in schema)], schema=schema)


def extend(docs: DataFrame, carry: list[str], text: str, add: Callable, added: StructType, rows: int = 256) -> DataFrame:
    """`carry` columns of every row and what `add(texts)` makes of its text, as columns `added`.

    `add` takes a list of texts (null: None) and gives a list or array per added column.  A carried column that
    has the name of an added one gives way.
    """
    new = {f.name.lower() for f in added}
    carry = [c for c in carry if c.lower() not in new]
    source = docs.select(*[docs[c] for c in carry], docs[text].alias("__text"))
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches):
        for b in slices(batches, rows):
            made = add(b.column(len(carry)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(carry)], *[pa.array(x, t) for x, t in zip(made, types)]],
                                             names=[*carry, *[f.name for f in added]])
        pa.default_memory_pool().release_unused()       # workers go on to other stages

    return source.mapInArrow(run, StructType([*source.schema.fields[:len(carry)], *added.fields]))
