"""A corpus from raw documents to packed training sequences, in stages.

Every stage takes an empty table and returns one. Null texts count as empty, null ids and
sources stay; repeated rows stay until the near-dedup, which makes rows equal in doc_id and
text one. Extra columns are dropped, whatever their names. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from eventloom.llm.common import stored, table
from eventloom.llm.lines import dedup_lines
from eventloom.llm.packing import pack_documents
from eventloom.llm.quality import keep_good
from eventloom.llm.secrets import scan_secrets
from eventloom.llm.simhash import one_of_each_group

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    kept = [F.col(c) for c in COLUMNS[:-1]]
    return df.select(*kept, F.length("text").cast("long").alias("n_chars"))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality ranking rejects. Null and empty texts are
    scored like others; equal texts get equal scores."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines of runs that an earlier document has; a document may become empty.
    Null texts stay null. Rows equal in doc_id and text lose the same lines."""
    return _documents(dedup_lines(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id (null last), of
    equal ids the smallest text hash. All null and empty texts are one group."""
    return one_of_each_group(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, null texts too; every secret found in them is blanked out, spans
    that overlap as one."""
    return _documents(scan_secrets(docs, replacement="[secret]"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents, packed: one row per piece, with its ids. A null or
    empty text has its closing token only."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeats),
    ("simhash near-dedup", without_copies),
    ("secret scans", without_secrets),
    ("packing", sequences),
]

#: A fitted classifier, an inferred automaton and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
