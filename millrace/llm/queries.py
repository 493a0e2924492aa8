"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .ball_kmeans import ORACLE_OP13, op13_centroids_ball_kmeans
from .bwt_dedup import op5_suffix_dedup_bwt
from .decontam import op9_decontaminate_spaced_seeds
from .jaccard import op8_jaccard_divideskip
from .media import op7_media_progressive_jpeg
from .chaining import op3_passages_chaining
from .mixing import ORACLE_OP6, op6_mix_pareto
from .near_vectors import ORACLE_OP12, op12_near_vectors_spherical
from .pii import op1_pii_boosted
from .quality import op10_quality_rff
from .schema_rewrite import op11_rewrite_field_ids
from .sharding import op4_shard_two_pass
from .toxicity import op2_toxicity_levenshtein


def queries():
    return {
        "op1_pii_boosted": op1_pii_boosted,
        "op2_toxicity_levenshtein": op2_toxicity_levenshtein,
        "op3_passages_chaining": op3_passages_chaining,
        "op4_shard_two_pass": op4_shard_two_pass,
        "op5_suffix_dedup_bwt": op5_suffix_dedup_bwt,
        "op6_mix_pareto": op6_mix_pareto,
        "op7_media_progressive_jpeg": op7_media_progressive_jpeg,
        "op8_jaccard_divideskip": op8_jaccard_divideskip,
        "op9_decontaminate_spaced_seeds": op9_decontaminate_spaced_seeds,
        "op10_quality_rff": op10_quality_rff,
        "op11_rewrite_field_ids": op11_rewrite_field_ids,
        "op12_near_vectors_spherical": op12_near_vectors_spherical,
        "op13_centroids_ball_kmeans": op13_centroids_ball_kmeans,
    }


def oracle_sql():
    return {"op6_mix_pareto": ORACLE_OP6, "op12_near_vectors_spherical": ORACLE_OP12, "op13_centroids_ball_kmeans": ORACLE_OP13}
