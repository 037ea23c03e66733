"""Column names, domain values and NA tokens.

Everything an operator needs to know about the table lives in one frozen
dataclass, so the operators also run on tables whose columns are named
differently: build a ``TaskConfig`` with other names and pass it along.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must stay equal to the source tool's labels so that
# results line up with it: domain values of the flag / status / geo columns,
# the display names of every column, the analyst-sheet layout and the CSV
# NA tokens.
# ---------------------------------------------------------------------------
FLAG_CONSTRUCTION = "Construction"
FLAG_MALL_TENANT = "Mall Tenant"
FLAG_MULTI_LEVEL = "Multi-Level"
FLAG_NORMAL = "Normal"
STATUS_VERIFIED_QA = "VerifiedQA"
STATUS_VERIFIED_ADMIN = "VerifiedAdmin"
STATUS_NONE = "None"
STATUS_DRAFT = "Draft"
GEO_VERIFIED = ("RETAILSTAT VERIFIED: ROOFTOP", "AGGDATA_VERIFIED: ROOFTOP")
SPLIT = "Split"
TOTAL_LABEL = "Total"
DUPLICATE_YES = "⚠️ Yes"
DUPLICATE_NO = "No"
SOURCE_FILE_1 = "File 1"
SOURCE_FILE_2 = "File 2"
COMPARISON_KINDS = ("ALI", "Address", "Migration")

# snake_case name -> display name of the source tool
DISPLAY_NAMES = {
    "category": "Category",
    "list_id": "List ID",
    "list_name": "List Name",
    "ali": "ALI",
    "polygon_status": "Polygon Status",
    "store_name": "Store Name",
    "address": "Address",
    "city": "City",
    "state": "State",
    "zip": "ZIP",
    "geo_accuracy": "Geo Accuracy",
    "sqft": "SQFT",
    "manual_sqft": "Manual SQFT",
    "sc": "SC",
    "user": "User",
    "type": "Type",
    "date_effective": "Date Effective",
    "latitude": "Latitude",
    "longitude": "Longitude",
    "parent_ali": "Parent ALI",
    "parent_store_name": "Parent Store Name",
    "parent_list_name": "Parent List Name",
    "hide_traffic": "HideTraffic",
    "hide_from_app": "HideFromApp",
    "last_updated": "LastUpdated",
    "hide_traffic_for": "hideTrafficFor",
    "construction_flag": "constructionFlag",
}

# Analyst sheet: 14 columns in this order; the five "fill" columns are blank.
LAUNCHER_LAYOUT = (
    "Date", "Category", "List ID", "List Name", "ALI", "Polygon Status",
    "Store Name", "Address", "City", "State", "ZIP", "Source-1", "Source-2",
    "Remark",
)
ANALYST_FILL = ("Date", "Polygon Status", "Source-1", "Source-2", "Remark")

# pandas' default CSV NA tokens
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TaskConfig:
    """Names of the task-list columns and the domain values they hold."""

    category: str = "category"
    list_id: str = "list_id"
    list_name: str = "list_name"
    ali: str = "ali"
    polygon_status: str = "polygon_status"
    store_name: str = "store_name"
    address: str = "address"
    city: str = "city"
    state: str = "state"
    zip: str = "zip"
    geo_accuracy: str = "geo_accuracy"
    latitude: str = "latitude"
    longitude: str = "longitude"
    parent_ali: str = "parent_ali"
    construction_flag: str = "construction_flag"

    flag_construction: str = FLAG_CONSTRUCTION
    flag_mall_tenant: str = FLAG_MALL_TENANT
    flag_multi_level: str = FLAG_MULTI_LEVEL
    flag_normal: str = FLAG_NORMAL
    status_verified_qa: str = STATUS_VERIFIED_QA
    status_verified_admin: str = STATUS_VERIFIED_ADMIN
    status_none: str = STATUS_NONE
    status_draft: str = STATUS_DRAFT
    geo_verified: tuple[str, ...] = GEO_VERIFIED
    na_tokens: tuple[str, ...] = field(default=NA_TOKENS)

    # -- column groups -----------------------------------------------------
    @property
    def required(self) -> tuple[str, ...]:
        """Columns every upload must have (the validator's list)."""
        return (
            self.ali, self.list_name, self.store_name, self.address,
            self.city, self.state, self.construction_flag,
            self.polygon_status, self.latitude, self.longitude,
        )

    @property
    def analyser_required(self) -> tuple[str, ...]:
        """The analyser also reads these two without a guard."""
        return self.required + (self.geo_accuracy, self.parent_ali)

    @property
    def compare_layout(self) -> tuple[str, ...]:
        """Projection used by every comparison, in output order."""
        return (
            self.list_name, self.ali, self.address, self.city, self.zip,
            self.polygon_status,
        )

    def display(self, name: str) -> str:
        """Display name of a configured column (the name itself if unknown)."""
        for attr, disp in DISPLAY_NAMES.items():
            if getattr(self, attr, None) == name:
                return disp
        return name

    @property
    def to_display(self) -> dict[str, str]:
        """Rename mapping ``{our column: display column}``."""
        out = {}
        for attr, disp in DISPLAY_NAMES.items():
            name = getattr(self, attr, attr)
            out[name] = disp
        return out


DEFAULT = TaskConfig()

# Spark types of the known columns; unknown columns pass through as read.
TASK_TYPES = {
    "category": "string",
    "list_id": "bigint",
    "list_name": "string",
    "ali": "bigint",
    "polygon_status": "string",
    "store_name": "string",
    "address": "string",
    "city": "string",
    "state": "string",
    "zip": "string",
    "geo_accuracy": "string",
    "latitude": "double",
    "longitude": "double",
    "parent_ali": "bigint",
    "construction_flag": "string",
}
