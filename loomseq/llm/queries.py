"""The contract's queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import align, bpe, divergence, iblt, pack, pii, pulearn, quality, simhash, substring, tokenfile, urls, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_substring_dedup": substring.query,
        "op2_harmonic_packing": pack.query,
        "op3_bpe": bpe.query,
        "op4_simhash": simhash.query,
        "op5_token_files": tokenfile.query,
        "op6_iblt_fingerprints": iblt.query,
        "op7_pii": pii.query,
        "op8_url_filter": urls.query,
        "op9_warc": warc.query,
        "op10_quality_rules": quality.query,
        "op11_token_alignment": align.query,
        "op12_source_divergence": divergence.query,
        "op13_quality_classifier": pulearn.query,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op12_source_divergence": divergence.SQL}
