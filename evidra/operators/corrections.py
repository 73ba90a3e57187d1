"""Changes to review rows: actions on many rows, corrections, rules between labels, decisions by place, and dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules between predicted labels in the order in which they apply:
#: (rule, evidence type that triggers it, labels that it sets).
RULES = [
    ("firsthand_consistency", "firsthand_usage", {"firsthand": "true"}),
    ("firsthand_consistency", "hearsay", {"firsthand": "false"}),
    ("integration_shape", "integration_failure", {"aspect": "developer_ergonomics", "task": "api_developer_workflow"}),
    ("pricing_aspect", "pricing_value_comment", {"aspect": "value"}),
    ("release_firsthand", "release_update_reaction", {"firsthand": "false"}),
]
#: Named sets of rules.
RULE_SETS = {
    "none": [],
    "firsthand_consistency": ["firsthand_consistency"],
    "high_purity": ["firsthand_consistency", "integration_shape", "pricing_aspect", "release_firsthand"],
}


def constrained(rows: DataFrame, rule_set: str, evidence: str = "evidence", fields: Sequence[str] = ("task", "aspect", "firsthand")) -> DataFrame:
    """Labels after the rules of a set, and ``<field>_changed``. A null evidence type triggers none."""
    out = {}
    for f in fields:
        label: Column = F.col(f)
        for rule, kind, sets in RULES:
            if rule in RULE_SETS[rule_set] and f in sets:
                label = F.when(F.col(evidence) == kind, sets[f]).otherwise(label)
        out |= {f: label, f"{f}_changed": ~label.eqNullSafe(F.col(f))}
    return rows.withColumns(out)


def bulk_actions(rows: DataFrame, actions: DataFrame, keys: Sequence[str], fields: Sequence[str], default_reason: str) -> DataFrame:
    """Rows (<f>, human_<f>, suggested_<f>, excluded, reason) after actions (*keys, action, new_reason), one for each key at most.

    accept_machine and accept_suggestion (else the machine's label) fill the
    human labels; exclude sets the flag and a reason; clear empties all;
    set_reason sets the reason alone.  Other rows stay as they are.
    """
    act = F.coalesce("action", F.lit(""))
    human = {f"human_{f}": F.when(act == "accept_machine", F.col(f)).when(act == "accept_suggestion", F.coalesce(f"suggested_{f}", f)).when(act != "clear", F.col(f"human_{f}")) for f in fields}
    excluded = (act == "exclude") | ((act != "clear") & F.coalesce("excluded", F.lit(False)))
    reason = F.when(act == "exclude", F.coalesce("new_reason", "reason", F.lit(default_reason))).when(act == "set_reason", F.col("new_reason")).when(act != "clear", F.col("reason"))
    return rows.join(actions, list(keys), "left").withColumns(human | {"excluded": excluded, "reason": reason}).drop("action", "new_reason")


def corrected(fields: Sequence[str]) -> Column:
    """True where a human label is given and differs from the machine's."""
    out = F.lit(False)
    for f in fields:
        out = out | (F.col(f"human_{f}").isNotNull() & ~F.col(f"human_{f}").eqNullSafe(F.col(f)))
    return out


def decided_by_place(queue: DataFrame, order: Sequence[str], decisions: DataFrame) -> DataFrame:
    """The queue, a report of bounded length, with decisions (place, ...) by 1-based place in ``order``."""
    return queue.withColumn("place", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(decisions), "place", "left")


def dump(pattern: str, *columns: str) -> Column:
    """One line of text for a row; line ends inside become spaces."""
    return F.regexp_replace(F.format_string(pattern, *columns), r"[\r\n]+", " ")
