"""Queries of the subpackage, by the name under which they are registered, and their SQL."""

from __future__ import annotations

from .chat import op6_chat
from .decontam import op4_decontam
from .disclosure import op11_personal_data
from .langid import op3_langid
from .lattice_lm import op2_lattice_lm
from .licences import op1_licences
from .mixing import op8_mixing
from .negatives import op13_hard_negatives
from .neardup import op9_neardup
from .oracles import ORACLES
from .packing import op7_packing
from .quality import op10_quality
from .secrets import op5_secrets
from .whitening import op12_whitening

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_licences": op1_licences,
    "op2_lattice_lm": op2_lattice_lm,
    "op3_langid": op3_langid,
    "op4_decontam": op4_decontam,
    "op5_secrets": op5_secrets,
    "op6_chat": op6_chat,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_neardup": op9_neardup,
    "op10_quality": op10_quality,
    "op11_personal_data": op11_personal_data,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}
