"""Column roles: ordered name rules that say how each source column may be used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class RoleRule:
    """A rule matches if any of its name tests does (and `contains`, if given, also holds)."""

    group: str
    decision: str
    reason: str
    names: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    contains: str | None = None

    def matches(self, column: Column) -> Column:
        found = column.isin(list(self.names)) if self.names else F.lit(False)
        for prefix in self.prefixes:
            found = found | column.startswith(prefix)
        for suffix in self.suffixes:
            found = found | column.endswith(suffix)
        return found & column.contains(self.contains) if self.contains else found


# Group and decision labels, reasons and name patterns of the column inventory.
# The first matching rule wins.
ROLE_RULES = (
    RoleRule(
        "target source", "target_derivation_only",
        "Directly identifies the winner; use it only to create radiant_win, then remove it.",
        names=("winner_id",),
    ),
    RoleRule(
        "target mapping", "target_derivation_only",
        "Needed to map winner_id to Radiant or Dire; excluded from the draft-only model.",
        names=("radiant_team_id", "dire_team_id"),
    ),
    RoleRule(
        "identifier", "tracking_only",
        "Useful for deduplication and tracing a row, but an arbitrary ID is not a feature.",
        names=("match_id",),
    ),
    RoleRule(
        "time", "split_only",
        "Use for the chronological split, not as a direct model feature.",
        names=("match_start_date_time",),
    ),
    RoleRule(
        "pre-match context", "use_feature",
        "The game patch is known before the match and changes hero balance.",
        names=("game_version_id",),
    ),
    RoleRule(
        "draft", "use_feature",
        "The selected hero is known when the draft ends and is a primary model input.",
        suffixes=("_hero_id",),
    ),
    RoleRule(
        "draft label", "display_only",
        "Human-readable duplicate of hero_id; keep for inspection, not as a second model feature.",
        suffixes=("_hero",),
    ),
    RoleRule(
        "post-match result", "exclude_leakage",
        "Created during or after the match and would reveal information unavailable at draft time.",
        names=("match_duration_seconds", "first_blood_time_seconds", "radiant_kills", "dire_kills"),
        suffixes=("_kills", "_deaths", "_assists", "_networth"),
    ),
    RoleRule(
        "role assignment", "exclude_leakage_risk",
        "May be assigned or inferred using match play; exclude until its timestamp and origin are verified.",
        suffixes=("_position", "_lane", "_role"),
    ),
    RoleRule(
        "player identity", "exclude_scope",
        "Potentially known before the match, but high-cardinality identity features complicate a simple draft model.",
        suffixes=("_id", "_name"), contains="player_",
    ),
    RoleRule(
        "team identity", "exclude_scope",
        "Known before the match, but excluded so the baseline measures draft information rather than team reputation.",
        names=("radiant_team_name", "dire_team_name"),
    ),
    RoleRule(
        "competition metadata", "exclude_scope",
        "Mostly available before the match, but not necessary for the smallest useful draft-only baseline.",
        names=("league", "series_id", "series_type"), prefixes=("league_",),
    ),
)
OTHER_ROLE = RoleRule(
    "other", "review_before_use",
    "Outside the baseline scope; verify availability before considering it as a feature.",
)


def with_role(
    columns: DataFrame,
    name: str = "column",
    rules: tuple[RoleRule, ...] = ROLE_RULES,
    other: RoleRule = OTHER_ROLE,
) -> DataFrame:
    """Add `column_group`, `v1_decision` and `reason` to a table of column names."""
    choice = None
    for rule in rules:
        role = F.struct(
            F.lit(rule.group).alias("column_group"),
            F.lit(rule.decision).alias("v1_decision"),
            F.lit(rule.reason).alias("reason"),
        )
        test = rule.matches(F.col(name))
        choice = F.when(test, role) if choice is None else choice.when(test, role)
    fallback = F.struct(
        F.lit(other.group).alias("column_group"),
        F.lit(other.decision).alias("v1_decision"),
        F.lit(other.reason).alias("reason"),
    )
    choice = fallback if choice is None else choice.otherwise(fallback)
    return columns.withColumn("_role", choice).select(*columns.columns, "_role.*")


def role_summary(inventory: DataFrame) -> DataFrame:
    """Columns per group and decision, with their names in table order."""
    names = F.array_sort(F.collect_list(F.struct("position", "column")))
    return inventory.groupBy("column_group", "v1_decision").agg(
        F.count("*").alias("columns"), F.min("position").alias("first_position"), F.array_join(names["column"], ", ").alias("names")
    )
