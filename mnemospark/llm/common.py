"""What the operators share: table access, folds by document id, and the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.joins import join_by_size
from mnemospark.session import shared_dir, written

__all__ = ["fold", "hold", "join_by_size", "shared_dir", "table", "text_groups", "text_of", "texts_of", "written"]

_HELD: dict[str, Callable[[], object]] = {}


def hold(owner: str, release: Callable[[], object]) -> None:
    """In a worker: owner's cache is the one in use; the caches of other operators are released.

    Workers outlive tasks and stages, so without this a pipeline's worker would hold the caches of all its operators.
    """
    others = [k for k in _HELD if k != owner]
    for other in others:
        _HELD.pop(other)()
    if others:
        _give_back()
    _HELD[owner] = release


def _give_back() -> None:
    """Hands memory that is free to the system: the allocator would keep it for this process."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_groups(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    """Lists of texts of about chars code points, so that work on a batch stays bounded; a longer text is its own."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(k: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod k; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % k


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id long, text) of documents; null text is empty. All else, whatever its name, stays behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
