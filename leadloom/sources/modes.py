"""Which tables a run works on: the main ones, those of extra tenants, or the ones for tests, as its settings say."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from leadloom.sources import views


class Mode(NamedTuple):
    """Names of tables, and how the companies of the mode are read."""

    companies: str
    queue: str
    submissions: str


MODES = {
    "primary": Mode("companies", "send_queue", "submissions"), "extra": Mode("companies_extra", "send_queue_extra", "submissions"), "test": Mode("companies", "send_queue_test", "submissions_test"),
}
#: Targetings whose queue and facts are the tests' and the extra tenants' own; the main tables hold all others.
TEST_TARGETINGS, EXTRA_TARGETINGS = (18, 19), (16, 17)
TARGETINGS_SQL = {"primary": "targeting_id < 16", "extra": "targeting_id in (16, 17)", "test": "targeting_id in (18, 19)"}


def mode_of(settings: dict[str, str]) -> str:
    """The mode of settings: TABLE_MODE if it is known, else test if TEST_MODE is true, else extra if COMPANY_TABLE names the extra tenants, else primary."""
    said = settings.get("TABLE_MODE", "").strip().lower()
    if said:
        if said not in MODES:
            raise ValueError(f"unknown TABLE_MODE: {said}")
        return said
    if settings.get("TEST_MODE", "").strip().lower() in ("1", "true", "yes"):
        return "test"
    return "extra" if settings.get("COMPANY_TABLE", "").strip() == "companies_extra" else "primary"


def tables(spark: SparkSession, sf_dir: str, settings: dict[str, str]) -> tuple[Mode, DataFrame, DataFrame, DataFrame]:
    """The mode's names, companies, queue and submissions."""
    mode = mode_of(settings)
    companies = views.companies_extra(spark, sf_dir) if mode == "extra" else views.companies(spark, sf_dir)
    own = TARGETINGS_SQL[mode]
    return MODES[mode], companies, views.send_queue(spark, sf_dir).where(own), views.submissions(spark, sf_dir).where(own)
