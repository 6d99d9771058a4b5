"""Filtering stages: operators' decisions taken on whole document tables, all columns kept.

Language and quality decide row by row, so their stages are one pass without a shuffle: each Arrow batch goes back
without its rejected rows. The two dedup stages join the decisions back by document.

Defined results: columns pass unchanged, whatever their names. Null and empty texts are rejected by the language stage
(no letter). Rows that repeat a document (same doc_id and text) leave the exact dedup stage once; rows of one doc_id with
different texts are decided apart there, and share one decision in the near-duplicate stage.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import language_id, quality
from mnemospark.llm.common import fold, hold, text_groups, text_of
from mnemospark.llm.exact_dedup import exact_dedup
from mnemospark.llm.near_dedup import near_dedup


def _filtered(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs for which keep(list of texts) is true."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(keep(["" if t is None else t for t in b.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_known_language(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """Rejects documents without letters, and those whose best language is under least."""
    model = language_id.fit(docs, fold(4) != 2, vocabulary)
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def keep(texts):
        m, out = language_id.live(packed.value), []
        for part in text_groups(texts, language_id.GROUP_CHARS):
            langs, score = m.predict(part)
            out += [k != language_id.UNDETERMINED and s >= least for k, s in zip(langs, score.tolist(), strict=True)]
        return out

    return _filtered(docs, keep)


def keep_good_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """Rejects documents that score under least."""
    shared = docs.sparkSession.sparkContext.broadcast(quality.fit(docs, labels, fold(4) != 2))

    def keep(texts):
        hold("quality", dict)
        return shared.value.score(np.array([quality.features(t) for t in texts]).reshape(len(texts), len(quality.FEATURES))) >= least

    return _filtered(docs, keep)


def _fresh(docs: DataFrame, stem: str) -> str:
    """A column name that docs does not have."""
    while stem.lower() in map(str.lower, docs.columns):
        stem += "_"
    return stem


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each text stays, that of the largest doc_id."""
    key = _fresh(docs, "text_sha256")
    kept = exact_dedup(docs, keep="largest").filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    marked = docs.withColumn(key, F.sha2(text_of().cast("binary"), 256))
    joined = marked.join(kept, marked["doc_id"].eqNullSafe(kept["kept_id"]) & (marked[key] == kept["kept_sha"]), "left_semi")
    return joined.dropDuplicates(["doc_id", key]).select(*docs.columns)


def drop_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each component of near-duplicates stays, that of the smallest doc_id."""
    kept = near_dedup(docs, percent=percent).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*docs.columns)
