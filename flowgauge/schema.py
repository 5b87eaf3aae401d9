"""Column roles: which column of a fact table plays which part in an analysis."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Short names users may write instead of a column name -> role.
COLUMN_ALIASES = {
    "counterparty": "partner",
    "counterparties": "partner",
    "entity": "partner",
    "state": "region",
    "location": "location",
    "pipeline": "pipeline",
}


@dataclass(frozen=True)
class FlowSchema:
    """Role -> column name. Set a role to ``None`` when the table has no such column."""

    pipeline: str | None = "pipeline_name"
    location: str | None = "loc_name"
    partner_pipeline: str | None = "connecting_pipeline"
    partner: str | None = "connecting_entity"
    sign: str | None = "rec_del_sign"
    category: str | None = "category_short"
    country: str | None = "country_name"
    region: str | None = "state_abb"
    subregion: str | None = "county_name"
    time: str = "eff_gas_day"
    measure: str = "scheduled_quantity"

    def mapped(self) -> dict[str, str]:
        """The roles that are mapped to a column."""
        pairs = {f.name: getattr(self, f.name) for f in fields(self)}
        return {role: column for role, column in pairs.items() if column is not None}

    def require(self, role: str) -> str:
        column = getattr(self, role)
        if column is None:
            raise ValueError(f"this analysis needs the role '{role}', which is not mapped")
        return column
