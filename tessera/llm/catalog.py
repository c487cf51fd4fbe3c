"""Queries of the corpus operators over the tables of a data folder, and their SQL."""

from __future__ import annotations

from .alignment import op11_alignment
from .decontaminate import op4_decontaminate
from .fingerprints import op12_fingerprints
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .language_id import op9_language_id
from .ngram_join import op6_ngram_join
from .quality import op5_quality
from .secret_scan import OP1_SQL, op1_secret_scan
from .sentence_pieces import op8_sentence_pieces
from .substring_dedup import op10_substring_dedup
from .token_counts import op7_token_counts
from .topk_search import OP3_SQL, op3_topk_search
from .toxicity import op2_toxicity

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_topk_search": op3_topk_search,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_ngram_join": op6_ngram_join,
    "op7_token_counts": op7_token_counts,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_alignment": op11_alignment,
    "op12_fingerprints": op12_fingerprints,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {"op1_secret_scan": OP1_SQL, "op3_topk_search": OP3_SQL, "op13_hard_negatives": OP13_SQL}
