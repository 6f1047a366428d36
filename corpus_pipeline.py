"""The training-data pipeline: language, near copies, repeated passages, benchmark passages, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm.common import documents, written
from starloom.session import ship

TOKENIZER = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; `lang` becomes the predicted one."""
    from starloom.llm.langid import kept

    return kept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the smallest id stays."""
    from starloom.llm.minhash import representatives

    return representatives(docs, 5, 80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut out."""
    from starloom.llm.substrings import shortened

    return shortened(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    from starloom.llm.decontaminate import decontaminated

    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids."""
    import public_tokenizers

    from starloom.llm.pieces import encoded

    return encoded(docs, public_tokenizers.path(TOKENIZER))


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("language", _shipped(language)),
    ("near_copies", _shipped(near_copies)),
    ("passages", _shipped(passages)),
    ("benchmarks", _shipped(benchmarks)),
    ("token_ids", _shipped(token_ids)),
]

#: Trained models and a tokenizer decide, which SQL cannot express; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
