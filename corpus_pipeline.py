"""The corpus pipeline: quality rules, near-dedup, suffix-array dedup, secret masking, packing.

Each stage's rows are written as Parquet in the shared folder and read again as the next one's documents, so a lost
executor never costs more than the stage at work.
"""

from pyspark.sql import DataFrame, SparkSession

from quillbase.llm import bag_minhash, packing, quality_rules, secret_scan, suffix_dedup
from quillbase.llm.common import documents, staged

STAGES = [
    ("quality rules", quality_rules.stage),
    ("near-dedup", bag_minhash.stage),
    ("suffix-array dedup", suffix_dedup.stage),
    ("secret scans", secret_scan.stage),
    ("best-fit packing", packing.stage),
]

#: The stages learn, hash and tokenise; SQL can't express them. Tests hold run() against brute force (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
