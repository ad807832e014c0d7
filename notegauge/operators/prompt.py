"""The judgment prompt, rendered from the vocabulary, and requests for single notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegauge.operators.validate import EVIDENCE_WORDS
from notegauge.vocab import COMPONENT_CAP, COMPONENT_CODES, JUDGMENT_VERSION, PROMPT_VERSION, vocabulary


def judgment_prompt(spark: SparkSession) -> str:
    """What a judge is told: the codes with their losses, how codes exclude one another, and the shape of an answer."""
    codes = [f"| `{r['code']}` | {r['loss']} | {r['message']} |" for r in vocabulary(spark).toLocalIterator()]
    parts = ", ".join(f"`{c}`" for c in sorted(COMPONENT_CODES))
    return "\n".join(
        [
            f"# Judging a note (prompt {PROMPT_VERSION})", "", "Read the whole note and answer with one JSON object and nothing else.",
            "Findings decide the score, which is computed afterwards: 100 less all losses, at least 1.", "", "| code | loss | use when |", "|---|---:|---|", *codes, "",
            f"- The codes {parts} are parts of one explanation; together they lose at most {COMPONENT_CAP}.",
            "- `invalid_dae` stands for all of its parts, `multi_note` for `not_atomic`.",
            "- A factual risk has one `factual_risk` finding, a reason, and both flags set.", f"- An excerpt has at most {EVIDENCE_WORDS} words.", "",
            f'Keys: schema_version ("{JUDGMENT_VERSION}"), prompt_version, note_path, dimension_adjustments, findings (code, message, evidence), factual_risk, factual_risk_reason, fact_check_required, evidence (excerpt, reason).', "",
        ]
    )


def single(rows: DataFrame, note_path: str) -> DataFrame:
    """The one audit row of a note; none or several are an error."""
    found = rows.filter(F.col("note_path") == note_path)
    n = len(found.select(F.lit(1)).limit(2).collect())
    if n != 1:
        raise ValueError(f"{'duplicate audit row' if n else 'audit row not found for'} note_path: {note_path}")
    return found


def request(spark: SparkSession, notes: DataFrame, note_path: str) -> str:
    """The prompt followed by the note."""
    note = single(notes, note_path).select("content").first()
    return f"{judgment_prompt(spark)}\n## Note\n\nnote_path: {note_path}\n\n{note['content']}\n"


def stale(rows: DataFrame) -> DataFrame:
    """Rows of another prompt version than the current one: judging them would waste work."""
    return rows.filter(~F.col("prompt_version").eqNullSafe(F.lit(PROMPT_VERSION)))


def unsafe_path(path):
    """Paths that could leave the vault or are no notes."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..") | ~path.endswith(".md")
