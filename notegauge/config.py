"""Configuration: defaults under the overrides of a JSON object in the vault."""

from __future__ import annotations

import json
from pathlib import Path

CONFIG_FILE = ".notegauge/config.json"
# The defaults.
DEFAULTS = {
    "schema_version": "1.0.0",
    "atomic_notes_folder": "Atomic Notes",
    "structure_notes_folder": "Structure Notes",
    "atomic_note_template": "Templates/Atomic Note Template.md",
    "audit_output_folder": "Reviews/Atomic Note Audits",
}


def resolve(vault: str, file: str = CONFIG_FILE) -> dict:
    path = Path(vault) / file
    if not path.exists():
        return dict(DEFAULTS)
    found = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} must contain a JSON object")
    return DEFAULTS | found
