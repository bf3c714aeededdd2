"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from .additive import op2_additive
from .hmm import op10_hmm
from .htmltext import op9_html
from .lines import op1_lines
from .mixing import OP4_SQL, op4_mixing
from .packing import op3_packing
from .passages import op8_passages
from .quality import OP7_SQL, op7_quality
from .simhash import op6_simhash
from .store import op5_store

_ALL = (op1_lines, op2_additive, op3_packing, op4_mixing, op5_store, op6_simhash, op7_quality, op8_passages, op9_html, op10_hmm)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op7_quality": OP7_SQL}
