"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op12_bpe
from .decontamination import op9_decontamination
from .divergence import OP11_SQL, op11_source_divergence
from .language_id import op10_language_id
from .mixing import op5_mixing_sources
from .periodic import op13_periodic_runs
from .pii import op6_pii
from .quality_classifier import op4_quality_classifier
from .quality_rules import op2_quality_rules
from .secrets import op7_secret_scan
from .sharding import op3_sharding
from .simhash import op1_simhash_near_dedup
from .warc import OP8_SQL, op8_warc_revisits

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_quality_rules,
        op3_sharding,
        op4_quality_classifier,
        op5_mixing_sources,
        op6_pii,
        op7_secret_scan,
        op8_warc_revisits,
        op9_decontamination,
        op10_language_id,
        op11_source_divergence,
        op12_bpe,
        op13_periodic_runs,
    )
}
ORACLE_SQL = {"op8_warc_revisits": OP8_SQL, "op11_source_divergence": OP11_SQL}
