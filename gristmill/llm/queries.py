"""The corpus operators' queries and their SQL twins."""

from __future__ import annotations

from . import decontaminate, licenses, mixing, quality, shards, simhash, suffixes, tokens, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity, mixing.op2_source_mixing, quality.op3_quality_rules, tokens.op4_token_files,
        simhash.op5_simhash_duplicates, suffixes.op6_repeated_bytes, licenses.op7_license_scan, shards.op8_feistel_sharding,
        warc.op9_warc_archives, decontaminate.op10_decontamination,
    )
}
SQL = {
    "op2_source_mixing": mixing.OP2_SQL, "op3_quality_rules": quality.OP3_SQL, "op7_license_scan": licenses.OP7_SQL, "op8_feistel_sharding": shards.OP8_SQL,
    "op6_repeated_bytes": suffixes.OP6_SQL, "op9_warc_archives": warc.OP9_SQL, "op10_decontamination": decontaminate.OP10_SQL,
}
