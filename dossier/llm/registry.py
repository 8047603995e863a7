"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from dossier.llm import centroids, decontaminate, langid, mixing, packing, phrases, quality, repeats, shuffle_shards, simhash, topk, warc, whitening


def queries() -> dict:
    return {
        "op1_langid": langid.op1_langid,
        "op2_warc": warc.op2_warc,
        "op3_phrases": phrases.op3_phrases,
        "op4_sharding": shuffle_shards.op4_sharding,
        "op5_quality": quality.op5_quality,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_repeats": repeats.op7_repeats,
        "op8_simhash": simhash.op8_simhash,
        "op9_topk": topk.op9_topk,
        "op10_mixing": mixing.op10_mixing,
        "op11_packing": packing.op11_packing,
        "op12_centroids": centroids.op12_centroids,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE_SQL,
        "op4_sharding": shuffle_shards.ORACLE_SQL,
        "op6_decontamination": decontaminate.ORACLE_SQL,
        "op9_topk": topk.ORACLE_SQL,
        "op10_mixing": mixing.ORACLE_SQL,
        "op12_centroids": centroids.ORACLE_SQL,
    }
