"""The queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op3_template_decontamination
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .jaccard import op8_chosen_path_join
from .language import op7_language_kernel
from .packing import op10_best_fit_packing
from .quality import op1_quality_crf
from .suffix_tree import op2_suffix_tree
from .tokens import op9_token_counts
from .url_filter import OP6_SQL, op6_url_filter
from .warc import OP5_SQL, op5_warc_archive

QUERIES = {
    "op1_quality_crf": op1_quality_crf,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_template_decontamination": op3_template_decontamination,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc_archive": op5_warc_archive,
    "op6_url_filter": op6_url_filter,
    "op7_language_kernel": op7_language_kernel,
    "op8_chosen_path_join": op8_chosen_path_join,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op5_warc_archive": OP5_SQL, "op6_url_filter": OP6_SQL}
