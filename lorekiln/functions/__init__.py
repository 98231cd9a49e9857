"""Column functions of all operators in one place: expressions to use in ``select`` and ``where``, all within the JVM."""

from lorekiln.operators.claims import fact_quality, preferred_value, value_text
from lorekiln.operators.evaluate import exact_match, overlap, role_signature, symmetric_ratio
from lorekiln.operators.frames import compile_status, question_semantics
from lorekiln.operators.hierarchy import clean_id
from lorekiln.operators.knowledge import claim_status, decimal_normal, factuality, signature
from lorekiln.operators.lexicon import cardinal, normal_name, relative_days, surface_tokens, unknown_bucket, words
from lorekiln.operators.resolve import pronoun_gender, pronoun_number, source_form
from lorekiln.operators.segment import paragraph_count, rule_sentences, sentence_count, simple_sentences, span_relation
from lorekiln.operators.temporal import expression_kind, iso_parts, time_relation
from lorekiln.sources.store import document_hash, document_id, redacted

__all__ = [
    "cardinal", "claim_status", "clean_id", "compile_status", "decimal_normal", "document_hash", "document_id", "exact_match", "expression_kind", "fact_quality", "factuality",
    "iso_parts", "normal_name", "overlap", "paragraph_count", "preferred_value", "pronoun_gender", "pronoun_number", "question_semantics", "redacted", "relative_days",
    "role_signature", "rule_sentences", "sentence_count", "signature", "simple_sentences", "source_form", "span_relation", "surface_tokens", "symmetric_ratio", "time_relation",
    "unknown_bucket", "value_text", "words",
]
