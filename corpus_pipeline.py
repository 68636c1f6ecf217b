"""From raw documents to packed training sequences: five stages, each reading what the one before has written.

Every stage takes null and empty texts, repeated rows, null keys and sources, further columns (also such whose names differ
only from those it makes) and empty tables; what becomes of them is said in each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.llm import host_quality, mixing, near_duplicates, packing, quality_classifier
from quireframe.llm.shared import delete, recorded, shared_folder, written

TOKENIZER = "byte_bpe_50k.json"
#: Near duplicates share four fifths of their five-word shingles.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: dict[str, list[str]] = {}


def staged(stage: Stage) -> Stage:
    """``stage`` for those who call the stages of ``STAGES`` one by one: as each has its rows written before the next is called,
    it first deletes the intermediate tables of the stage before it. Those of the last stage, which its rows are read from,
    stay. ``run`` takes the stages as they are, so that it meets no tables but its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        functions = [f.__name__ for _, f in STAGES]
        at = functions.index(stage.__name__)
        if at:
            delete(spark, _before.pop(functions[at - 1], []))
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        if at + 1 < len(functions):
            _before.setdefault(stage.__name__, []).extend(paths)
        return out

    return run


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not mostly failures. Null and empty texts have no words and go;
    a null source is a host; rows that repeat are measured and kept each."""
    return host_quality.keep_documents(docs)


@staged
def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. It is fitted on labelled rows of the whole documents table, as the
    rules before have taken most bad examples out. A null text counts as empty and has a score; rows that repeat have
    the same; a null key is never a labelled one."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_classifier.fit(texts, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_documents(docs, model)


@staged
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id (null: the largest); one of rows that
    repeat. Texts without words, null ones among them, are in no group and stay."""
    return near_duplicates.keep_one_of_each(docs, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


@staged
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 0 to 2 times. Rows without words are taken no time; a null
    source is a source; rows that repeat are drawn each."""
    return mixing.take_documents(docs)


@staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null text is an empty one, of one id; rows that repeat or have a null key are
    packed each."""
    pieces = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", classified),
    ("near_duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Compression, parity sketches and tokenizers are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's intermediate tables, and the rows of the one before, are deleted once
    its own rows are written; those that the returned rows are read from stay until ``clean_up``. Several runs do not meet."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with recorded() as paths:
            docs = written(stage.__wrapped__(spark, docs, sf_dir), f"stage-{name}")
        delete(spark, held + [p for p in paths if p != docs._written_to])
        held = [docs._written_to]
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder. What was returned before cannot be read afterwards."""
    delete(spark, [shared_folder(spark)])
