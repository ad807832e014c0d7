"""A small vault of our own: one note per rule."""

from pathlib import Path

FRONT = "---\ntitle: note\n---\n"
BODY = """Caching is the practice of keeping computed results close at hand so that later requests can be answered quickly.

It is like a cook keeping chopped onions beside the stove during a busy evening service.

For example, a web server keeps rendered pages in memory and hands them out again without asking the database.
"""
CARD = "\nTARGET DECK: General\nSTART\nBasic\nWhat is caching?\nBack: keeping results close.\n<!--ID: 17-->\nEND\n"
NOTES = {
    "202401010101 clean": (FRONT + "# Caching\n\n" + BODY, True, []),
    "202401010102 weak": (FRONT + "# Weak\n\nOne short paragraph.\n", False, ["invalid_dae", "missing_parent", "weak_dae"]),
    "202401010103 bundle": (FRONT + "# One\n\nShort.\n" + CARD + "\n# Two\n\nAlso short.\n" + CARD, False, ["invalid_dae", "missing_parent", "multi_note", "weak_dae"]),
    "202401010104 misfiled": ("---\nsource: a book\n---\n# Notes\n\nHighlight: something nice.\n", False, ["invalid_dae", "missing_parent", "misfiled_reference", "weak_dae"]),
    "202401010105 unparented": (FRONT + "# Caching\n\n" + BODY, False, ["missing_parent"]),
    "202401010106 risky": (FRONT + "# Caching\n\n" + BODY + "\nEveryone always remembers everything after a cache lesson.\n", False, ["missing_parent", "factual_risk"]),
    "202401010107 card": (FRONT + "# Caching\n\n" + BODY + CARD, True, []),
    "202401010108 unbalanced": (FRONT + "# Caching\n\n" + BODY + "\nSTART\nBasic\nQuestion\nBack: answer\n", False, ["missing_parent", "malformed_anki"]),
    "202401010109 overlap": (FRONT + "# Caching\n\n" + BODY + "\nThis is an overlap candidate for review.\n", True, ["duplicate_overlap"]),
    "202401010110 references": (FRONT + "# Caching\n\n" + BODY + "\nReference:\n- [[somewhere]]\n\nSources:\n1. A 2019 study found 45% of things.\n", True, []),
}
SCORES = {"clean": (100, None), "weak": (42, "P0"), "bundle": (5, "P0"), "unparented": (92, "P3"), "risky": (84, "P2"), "unbalanced": (74, "P2"), "overlap": (92, "P3")}


def write(root: Path) -> Path:
    for folder in ("Atomic Notes", "Structure Notes", "Templates"):
        (root / folder).mkdir(parents=True)
    for stem, (text, _, _) in NOTES.items():
        (root / "Atomic Notes" / f"{stem}.md").write_text(text, encoding="utf-8")
    links = "\n".join(f"- [[{stem}]]" for stem, (_, linked, _) in NOTES.items() if linked)
    (root / "Structure Notes" / "hub.md").write_text(f"# Hub\n\n{links}\n\n```\n[[202401010105 unparented]]\n```\n", encoding="utf-8")
    (root / "Templates" / "t.md").write_text("# template\n", encoding="utf-8")
    return root
