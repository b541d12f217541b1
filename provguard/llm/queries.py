"""Registered queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

from .decontaminate import op3_decontaminate
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .language_id import op8_language_id
from .lexical_search import OP13_SQL, op13_lexical_search
from .license_scan import op2_license_scan
from .mixing import OP5_SQL, op5_mix_sources
from .ngram_join import OP6_SQL, op6_ngram_join
from .packing import op11_pack_sequences
from .quality_rules import op1_quality_rules
from .site_quality import op10_site_quality
from .substring_dedup import OP7_SQL, op7_substring_dedup
from .suffix_dedup import op4_suffix_dedup
from .token_count import op9_token_counts

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_ngram_join": op6_ngram_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_site_quality": op10_site_quality,
    "op11_pack_sequences": op11_pack_sequences,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {"op5_mix_sources": OP5_SQL, "op6_ngram_join": OP6_SQL, "op7_substring_dedup": OP7_SQL,
              "op12_hard_negatives": OP12_SQL, "op13_lexical_search": OP13_SQL}
