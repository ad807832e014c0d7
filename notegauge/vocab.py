"""The controlled vocabulary of findings and the tables that scoring reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Each finding code with its loss, its message and the mode of its recommendation, in order of declaration.
FINDINGS = (
    ("missing_frontmatter", 8, "Add YAML frontmatter with the note's metadata.", "improve-in-place"),
    ("invalid_dae", 35, "Add complete Definition, Analogy, and Example content.", "improve-in-place"),
    ("definition_too_long", 20, "Shorten the Definition to 10-50 rendered words.", "improve-in-place"),
    ("missing_parent", 8, "Link this note from a structure note.", "link-parent"),
    ("malformed_anki", 18, "Balance START and END markers for Anki card blocks.", "improve-in-place"),
    ("anki_yagni", 5, "Confirm this Anki card is worth memorizing for the intended learner before keeping it.", "confirm-anki-utility"),
    ("multi_note", 45, "Split bundled ideas into separate atomic notes.", "split-multi-note"),
    ("misfiled_reference", 35, "Move source-material notes out of Atomic Notes or rewrite them as DAE notes.", "rehome-non-DAE"),
    ("weak_dae", 15, "Strengthen the DAE content with concrete, self-contained explanations.", "improve-in-place"),
    ("not_atomic", 25, "Rewrite the note around one durable concept.", "improve-in-place"),
    ("weak_definition", 18, "Rewrite the Definition so it is complete, concise, and standalone.", "improve-in-place"),
    ("weak_analogy", 15, "Replace the Analogy with a familiar concrete referent and shared relation.", "improve-in-place"),
    ("weak_example", 15, "Replace the Example with a concrete case that starts with 'For example,'.", "improve-in-place"),
    ("unclear", 15, "Rewrite unclear or misleading prose before relying on the note.", "improve-in-place"),
    ("title_body_mismatch", 15, "Align each mismatched naming pair: make the timestamp-stripped filename exactly match the reader-visible applicable Definition source without its final period, using the approved rename flow when that pair differs; make the YAML title and H1 use the same short concept name, and correct that concept if it differs from the Definition.", "improve-in-place"),
    ("duplicate_overlap", 8, "Review this note against related notes for possible overlap.", "duplicate-overlap-review"),
    ("factual_risk", 8, "Mark empirical, current, attributed, or sensitive-domain claims for fact checking.", "mark-factual-risk"),
)

# Codes that share one capped loss, and that cap.
COMPONENT_CODES = ("definition_too_long", "weak_definition", "weak_dae", "weak_analogy", "weak_example")
COMPONENT_CAP = 35
# Deterministic findings that a judgment does not replace.
RETAINED_CODES = ("missing_frontmatter", "missing_parent", "malformed_anki", "duplicate_overlap")

# The six dimensions and what each finding takes from them.
DIMENSIONS = ("structure", "atomicity", "dae_quality", "clarity", "connections", "metadata_card_safety")
PENALTIES = {
    "missing_frontmatter": {"structure": 20, "metadata_card_safety": 40},
    "invalid_dae": {"structure": 35, "dae_quality": 60, "clarity": 20},
    "definition_too_long": {"structure": 20, "dae_quality": 35, "clarity": 25},
    "missing_parent": {"connections": 60},
    "malformed_anki": {"metadata_card_safety": 50, "clarity": 10},
    "multi_note": {"structure": 30, "atomicity": 70, "clarity": 20},
    "misfiled_reference": {"structure": 30, "atomicity": 40, "dae_quality": 50},
    "weak_dae": {"dae_quality": 25, "clarity": 15},
    "factual_risk": {"clarity": 20, "metadata_card_safety": 10},
    "duplicate_overlap": {"atomicity": 25, "clarity": 10, "connections": 10},
}

# Versions stamped on rows and judgments, and the key sets of counts.
SCHEMA_VERSION, DOCTRINE_VERSION, RUBRIC_VERSION, PROMPT_VERSION, JUDGMENT_VERSION = "1.0.0", "1.0.4", "1.0.1", "1.0.2", "2.0.0"
BUCKETS = ("P0", "P1", "P2", "P3", "no_change")
ROW_STATUSES = ("complete", "reused_cache", "error", "skipped")
CACHE_STATUSES = ("none", "miss", "hit", "partial")
VALIDATION_STATUSES = ("passed", "failed", "not_run")
FIXED_TIME = "2000-01-01T00:00:00Z"

CODES = tuple(f[0] for f in FINDINGS)
LOSSES = {f[0]: f[1] for f in FINDINGS}
MESSAGES = {f[0]: f[2] for f in FINDINGS}
MODES = {f[0]: f[3] for f in FINDINGS}


def vocabulary(spark: SparkSession) -> DataFrame:
    """The vocabulary as a table of 17 rows: code, loss, message, mode, component."""
    rows = [(*f, f[0] in COMPONENT_CODES) for f in FINDINGS]
    return spark.createDataFrame(rows, "code string, loss int, message string, mode string, component boolean")
