"""The corpus pipeline: quality, lines, near duplicates, benchmark passages, tokens.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir). run() applies them to `documents`,
with each stage's rows cut to the shared folder before the next reads them.
"""

from pyspark.sql import DataFrame, SparkSession

from versicle import worker_path
from versicle.llm import stages
from versicle.llm.common import cut, table
from versicle.llm.queries import model_bytes


def _ready(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        worker_path(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _ready(stages.quality)),
    ("line dedup", _ready(stages.lines)),
    ("n-gram Jaccard join", _ready(stages.near_duplicates)),
    ("benchmark decontamination", _ready(stages.decontaminate)),
    ("SentencePiece encoding and decoding", _ready(lambda spark, docs, sf_dir: stages.tokens(model_bytes())(spark, docs, sf_dir))),
]
#: No SQL can express the classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
