"""The queries of this subpackage by name, and SQL for those that it can express."""

from quillon.llm.decontaminate import OP6_SQL, op6_benchmark_decontamination
from quillon.llm.htmltext import OP3_SQL, op3_html_extraction
from quillon.llm.language import OP5_SQL, op5_language_id
from quillon.llm.neardup import OP4_SQL, op4_minhash_near_dedup
from quillon.llm.packing import op7_packing
from quillon.llm.quality import OP8_SQL, op8_quality_rules
from quillon.llm.secrets import OP1_SQL, op1_secret_scans
from quillon.llm.sharding import op10_sharding
from quillon.llm.substrings import OP2_SQL, op2_suffix_array_dedup
from quillon.llm.urlfilter import OP9_SQL, op9_url_filters

QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_suffix_array_dedup, op3_html_extraction, op4_minhash_near_dedup, op5_language_id, op6_benchmark_decontamination, op7_packing, op8_quality_rules, op9_url_filters, op10_sharding)}
ORACLE_SQL: dict[str, str] = {"op1_secret_scans": OP1_SQL, "op2_suffix_array_dedup": OP2_SQL, "op3_html_extraction": OP3_SQL, "op4_minhash_near_dedup": OP4_SQL, "op5_language_id": OP5_SQL, "op6_benchmark_decontamination": OP6_SQL, "op8_quality_rules": OP8_SQL, "op9_url_filters": OP9_SQL}
