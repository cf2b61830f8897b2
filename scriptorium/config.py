"""Settings and closed lists that the checker's stages share."""

from __future__ import annotations

from dataclasses import dataclass

# The twelve error classes, with category, stage (None: declared, without detector).
ERROR_CLASSES = {
    "NON_WORD": ("spelling", 1),
    "HOMONYM": ("spelling", 1),
    "NOTVA_SHOTVA": ("spelling", 1),
    "CASE_MARKER": ("grammar", None),
    "CLASSIFIER": ("grammar", 1),
    "VERB_INFLECTION": ("grammar", 1),
    "WORD_ORDER": ("grammar", None),
    "POS_ERROR": ("grammar", None),
    "AGREEMENT": ("grammar", 1),
    "GURUCHANDALI_DOSHA": ("style", 1),
    "REGISTER_INCONSISTENCY": ("style", 1),
    "PUNCTUATION": ("punctuation", 1),
}
# Confidences of the detectors.
CONFIDENCE = {
    "violation": 0.93,
    "unknown_with_suggestions": 0.72,
    "unknown_alone": 0.35,
    "verb_person": 0.86,
    "double_plural": 0.84,
    "animacy": 0.80,
    "animate_plural": 0.82,
    "possessive": 0.82,
    "standard_form": 0.62,
    "register_clash": 0.74,
    "register_drift": 0.58,
    "space_before": 0.88,
    "missing_space": 0.82,
    "repeated_mark": 0.80,
    "multiple_spaces": 0.85,
    "latin_period": 0.79,
}
#: Words that make a lexicon complete; smaller ones damp the confidence of unknown words.
FULL_LEXICON = 150_000
SUGGEST_BUDGET = 25
#: Words of a lexicon that are sent to all tasks as a word graph (about 2 s to make, 200 MB); more are joined.
GRAPH_WORDS = 200_000
#: What one request may hold, for PipelineConfig(max_text=...); a corpus has no such limit.
REQUEST_MAX_TEXT = 200_000

EDIT_DDL = "start int, end int, original string, suggestions array<string>, error_class string, confidence double, stage int, rule string, seq int"


@dataclass(frozen=True)
class PipelineConfig:
    """What the resolver keeps; enabled_classes None keeps every class."""

    min_confidence: float = 0.55
    max_suggestions: int = 5
    enabled_classes: tuple[str, ...] | None = None
    max_edits: int = 500
    max_text: int | None = None


@dataclass(frozen=True)
class Gates:
    """Limits of the evaluation gate."""

    max_clean_fp: float = 0.03
    max_f05_drop: float = 0.02
    min_human_verified: int = 600
    max_stage4_share: float = 0.25
