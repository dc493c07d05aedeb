"""The registered queries of this package, and oracle SQL where SQL can express them."""

from __future__ import annotations

from .compression_bands import op6_compression_bands
from .edit_counts import op1_edit_aware_counts
from .flac import op5_flac_media
from .gam_quality import op10_gam_quality
from .bayes_minhash import op9_bayes_minhash
from .bin_slack import op3_min_bin_slack
from .line_spread import ORACLE_SQL as OP7_SQL
from .line_spread import op7_line_spread
from .merge_replay import op8_bpe_merge_replay
from .surrogates import op4_surrogates
from .toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_edit_aware_counts,
        op2_toxicity,
        op3_min_bin_slack,
        op4_surrogates,
        op5_flac_media,
        op6_compression_bands,
        op7_line_spread,
        op8_bpe_merge_replay,
        op9_bayes_minhash,
        op10_gam_quality,
    )
}
ORACLE: dict[str, str] = {"op7_line_spread": OP7_SQL}
