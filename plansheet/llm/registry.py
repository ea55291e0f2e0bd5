"""The queries of this subpackage and, where SQL can express one, its SQL."""

from plansheet.llm.audit import OP11_SQL, op11_filter_audit
from plansheet.llm.lines import OP13_SQL, op13_line_dedup
from plansheet.llm.manifest import OP12_SQL, op12_merkle_manifest
from plansheet.llm.media import op2_media_columns
from plansheet.llm.mixing import OP4_SQL, op4_source_mixing
from plansheet.llm.neighbours import op8_nearest_neighbours
from plansheet.llm.packing import op3_best_fit_packing
from plansheet.llm.secrets import op6_secret_scan
from plansheet.llm.simhash import op7_simhash
from plansheet.llm.substrings import OP10_SQL, op10_substring_dedup
from plansheet.llm.tokens import op1_token_counts
from plansheet.llm.toxicity import op9_toxicity
from plansheet.llm.warc import OP5_SQL, op5_warc

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_media_columns, op3_best_fit_packing, op4_source_mixing, op5_warc, op6_secret_scan, op7_simhash, op8_nearest_neighbours, op9_toxicity, op10_substring_dedup, op11_filter_audit, op12_merkle_manifest, op13_line_dedup)}
ORACLE_SQL = {"op4_source_mixing": OP4_SQL, "op5_warc": OP5_SQL, "op10_substring_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_line_dedup": OP13_SQL}
