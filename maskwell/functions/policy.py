"""The label policy, the prompt names that map to it, and prompt groups, as small tables of a fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels that a span may have (fixed values).
POLICY = (
    "first_name last_name full_name date_of_birth age gender race_ethnicity sexuality religion language nationality "
    "country city state county street_address postal_code phone_number email url ip_address mac_address username "
    "password company_name occupation employment_status salary income date time ssn passport_number national_id "
    "driver_license medical_record_number blood_type medical_condition medication health_insurance_number "
    "bank_account_number bank_routing_number swift_bic iban credit_debit_card credit_card_pin vehicle_identifier "
    "license_plate biometric other_pii education_level religious_belief biometric_identifier tax_id date_time pin "
    "health_plan_beneficiary_number"
).split()
#: Prompts that have another name than their label (fixed values).
RENAMED = {
    "name": "full_name",
    "postcode": "postal_code",
    "user_name": "username",
    "account_number": "bank_account_number",
    "credit_card_number": "credit_debit_card",
    "ipv4": "ip_address",
    "ipv6": "ip_address",
}
#: Labels of the policy that no prompt asks for, as another label takes their place (fixed values).
NOT_PROMPTED = ("religion", "biometric", "health_insurance_number", "credit_card_pin")
GROUP_SIZE = 24


def label_map() -> dict[str, str]:
    """prompt -> label"""
    renamed = set(RENAMED.values())
    return {p: p for p in POLICY if p not in renamed and p not in NOT_PROMPTED} | RENAMED


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in POLICY], "label string")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(label_map().items()), "prompt string, label string")


def prompt_groups(spark: SparkSession, size: int = GROUP_SIZE) -> DataFrame:
    """prompt, label, grp: prompts in alphabetical order, `size` to a group. A window over a table of fixed size."""
    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("prompt"))
    return labels(spark).withColumn("grp", F.floor((n - 1) / size).cast("long"))


def sql_values(rows) -> str:
    """VALUES lists for SQL twins of these tables."""
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
