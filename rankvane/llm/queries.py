"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from . import jaccard, linededup, ranked, vectorcodes, warc
from .bpe import op3_bpe_encode_decode
from .decontaminate import op4_decontaminate
from .jaccard import op13_jaccard_components
from .linededup import op2_line_dedup
from .perplexity import op8_kneser_ney_perplexity
from .pii import op5_personal_data
from .ranked import op12_ranked_search
from .rules import op7_quality_rules
from .simhash import op10_simhash_components
from .suffixdedup import op9_suffix_dedup
from .toxicity import op6_toxicity_cnn
from .vectorcodes import op11_vector_codes
from .warc import op1_warc_derivatives


def queries() -> dict:
    all_ = (
        op1_warc_derivatives,
        op2_line_dedup,
        op3_bpe_encode_decode,
        op4_decontaminate,
        op5_personal_data,
        op6_toxicity_cnn,
        op7_quality_rules,
        op8_kneser_ney_perplexity,
        op9_suffix_dedup,
        op10_simhash_components,
        op11_vector_codes,
        op12_ranked_search,
        op13_jaccard_components,
    )
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_derivatives": warc.OP1_SQL,
        "op2_line_dedup": linededup.OP2_SQL,
        "op11_vector_codes": vectorcodes.OP11_SQL,
        "op12_ranked_search": ranked.OP12_SQL,
        "op13_jaccard_components": jaccard.OP13_SQL,
    }
