"""The operators' registered queries: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from . import covertree, media, ngramjoin, pointintime, recompress, sharding, tokenfile, variants, warc
from .bpe import round_trip
from .common import table
from .htmltext import main_text
from .packing import pack_digest
from .toxicity import toxicity_report


def queries() -> dict:
    return {
        "op1_mixture_packing": lambda spark, sf: pack_digest(table(spark, sf, "documents")),
        "op2_recompression_dedup": lambda spark, sf: recompress.substring_digest(table(spark, sf, "documents")),
        "op3_warc_segments": lambda spark, sf: warc.archive_round_trip(table(spark, sf, "pages")),
        "op4_ordinal_toxicity": lambda spark, sf: toxicity_report(table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op5_media_sniffing": lambda spark, sf: media.media_digest(table(spark, sf, "documents")),
        "op6_sampled_splitters": lambda spark, sf: sharding.shard_digest(table(spark, sf, "documents")),
        "op7_wrapper_induction": lambda spark, sf: main_text(table(spark, sf, "pages")),
        "op8_cover_tree": lambda spark, sf: covertree.near_duplicates(table(spark, sf, "embeddings")),
        "op9_byte_bpe": lambda spark, sf: round_trip(table(spark, sf, "documents")),
        "op10_ngram_join": lambda spark, sf: ngramjoin.ngram_digest(table(spark, sf, "documents")),
        "op11_point_in_time": lambda spark, sf: pointintime.feature_table(table(spark, sf, "sales"), table(spark, sf, "sale_lines"), table(spark, sf, "clicks")),
        "op12_token_files": lambda spark, sf: tokenfile.token_file_round_trip(table(spark, sf, "documents")),
        "op13_spelling_variants": lambda spark, sf: variants.spelling_variants(table(spark, sf, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_recompression_dedup": recompress.ORACLE,
        "op3_warc_segments": warc.ORACLE,
        "op5_media_sniffing": media.ORACLE,
        "op6_sampled_splitters": sharding.ORACLE,
        "op8_cover_tree": covertree.ORACLE,
        "op10_ngram_join": ngramjoin.ORACLE,
        "op11_point_in_time": pointintime.ORACLE,
        "op13_spelling_variants": variants.ORACLE,
    }
