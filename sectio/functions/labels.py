"""Label values and label clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the annotated data -------------------------
# Dirty domain spellings in the mapping sheet and their clean forms.
LABEL_FIXES = {
    "Adverse_x000D_ events": "Adverse events",
    "Blood and lymphatic system _x000D_outcomes": "Blood and lymphatic system outcomes",
    "Infection and infestation\n outcomes": "Infection and infestation outcomes",
}
# Resource-use domains left out of domain training and reports.
LABELS_EXCLUDE = ["Hospital", "Need for further intervention", "Economics"]
# Class names of the binary stage.
OUTCOME = "outcome"
NOT_OUTCOME = "not outcome"
# Label given by the reject option and by one-vs-rest collapse.
NO_OUTCOME = "No outcome"
OTHER = "Other outcome"
# -----------------------------------------------------------------------------

# Whitespace of every kind at either end (trim() alone strips only spaces).
WS = "[ \\t\\n\\r\\f\\x0B]"
STRIP_RE = f"^{WS}+|{WS}+$"


def strip_all(c: Column) -> Column:
    return F.regexp_replace(c, STRIP_RE, "")


def clean_label(c: Column) -> Column:
    """F6 then F7: whole-value dictionary replacement, then strip."""
    fixed = F.coalesce(F.create_map(*[F.lit(x) for kv in LABEL_FIXES.items() for x in kv])[c], c)
    return strip_all(fixed)


def one_vs_rest(c: Column, keep: str, other: str = OTHER) -> Column:
    """Every label but ``keep`` becomes ``other``; a missing label is not
    ``keep`` either, so it becomes ``other`` too (pandas ``!=`` semantics)."""
    return F.when(c.eqNullSafe(F.lit(keep)), c).otherwise(F.lit(other))
