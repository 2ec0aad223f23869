"""The registered query and, where SQL can express it, the SQL of each operator."""

from . import decontamination, line_dedup, packing, pii_surrogates, piece_codec, quality_rules, rule_ensemble, secret_scan, shingle_join, suffix_dedup
from .common import table


def model_bytes() -> bytes:
    import public_tokenizers

    return piece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def _documents(query):
    return lambda spark, sf_dir: query(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_secret_scan": _documents(secret_scan.query),
        "op2_quality_rules": _documents(quality_rules.query),
        "op3_packing": _documents(lambda docs: packing.pack(docs, model_bytes())),
        "op4_pii_surrogates": _documents(pii_surrogates.query),
        "op5_decontamination": lambda spark, sf_dir: decontamination.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op6_shingle_join": _documents(shingle_join.query),
        "op7_suffix_dedup": _documents(suffix_dedup.query),
        "op8_rule_ensemble": lambda spark, sf_dir: rule_ensemble.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op9_line_dedup": _documents(line_dedup.query),
        "op10_piece_codec": _documents(lambda docs: piece_codec.digest(docs, model_bytes())),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan.SQL, "op2_quality_rules": quality_rules.SQL, "op5_decontamination": decontamination.SQL, "op6_shingle_join": shingle_join.SQL, "op7_suffix_dedup": suffix_dedup.SQL, "op9_line_dedup": line_dedup.SQL}
