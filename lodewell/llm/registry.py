"""Queries of this subpackage and their DuckDB SQL, for the repository's entry point."""

from .kdtree import op2_kdtree_sharding
from .langid import op9_language_id
from .licenses import op11_license_scans
from .lm import op10_kneser_ney
from .mixing import OP1_SQL, op1_mixing
from .packing import op7_best_fit_packing
from .resample import OP12_SQL, op12_importance_resampling
from .simhash import op3_simhash_near_dedup
from .substring import op4_substring_dedup
from .trie import OP13_SQL, op13_conversation_trie
from .warc import OP5_SQL, op5_warc
from .webp import op6_webp_media
from .winnow import op8_winnowing

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_kdtree_sharding": op2_kdtree_sharding,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_warc": op5_warc,
    "op6_webp_media": op6_webp_media,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_winnowing": op8_winnowing,
    "op9_language_id": op9_language_id,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_license_scans": op11_license_scans,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLE_SQL = {"op1_mixing": OP1_SQL, "op5_warc": OP5_SQL, "op12_importance_resampling": OP12_SQL, "op13_conversation_trie": OP13_SQL}
