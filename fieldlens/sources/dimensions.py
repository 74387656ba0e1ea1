"""Dimension sources: code sets and test-data profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PROFILE_SCHEMA = ("name string, description string, debtor_name string, debtor_iban string, debtor_bic string, debtor_country string, debtor_street string, debtor_city string, "
                  "debtor_postal_code string, creditor_name string, creditor_iban string, creditor_bic string, creditor_country string, creditor_street string, creditor_city string, "
                  "creditor_postal_code string, amount_min double, amount_max double, currency string, service_level string, local_instrument string, charge_bearer string")
# the profile used when no file is given
FALLBACK = ("domestic_sepa", "Domestic SEPA Credit Transfer (Fallback)", "Test Debtor", "DE89370400440532013000", "DEUTDEFF", "DE", "Test Street 1", "Berlin", "10115",
            "Test Creditor", "DE91100000000123456789", "MARKDEFF", "DE", "Test Street 2", "Munich", "80331", 10.0, 50000.0, "EUR", "SEPA", "CORE", "SLEV")

_PARTY = "struct<name:string,iban:string,bic:string,country:string,address:struct<street:string,city:string,postal_code:string,country:string>>"
_PROFILE = (f"struct<description:string,debtor:{_PARTY},creditor:{_PARTY},amount:struct<min:double,max:double,currency:string>,"
            "service_level:string,local_instrument:string,charge_bearer:string>")


def _json_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """Texts of JSON files, or None when there are none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None


def read_code_sets(spark: SparkSession, path: str) -> DataFrame:
    """(code_set, pos, code) from ``definitions.*.enum`` of JSON files; a missing file gives no rows."""
    docs = _json_documents(spark, path)
    if docs is None:
        return spark.createDataFrame([], "code_set string, pos int, code string")
    definitions = F.from_json("value", "definitions map<string, struct<enum: array<string>>>")["definitions"]
    return (docs.select(F.explode(definitions).alias("code_set", "d"))
            .select("code_set", F.posexplode("d.enum").alias("pos", "code")))


def read_profiles(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Profiles (parties, amount range, codes) of a JSON file; the built-in one when there is none."""
    docs = _json_documents(spark, path) if path else None
    if docs is None:
        return spark.createDataFrame([FALLBACK], PROFILE_SCHEMA)
    p = docs.select(F.explode(F.from_json("value", f"profiles map<string, {_PROFILE}>")["profiles"]).alias("name", "p"))
    party = lambda s: [F.col(f"p.{s}.{c}").alias(f"{s}_{c}") for c in ("name", "iban", "bic", "country")] + [
        F.col(f"p.{s}.address.{c}").alias(f"{s}_{c}") for c in ("street", "city", "postal_code")]
    return p.select("name", F.col("p.description").alias("description"), *party("debtor"), *party("creditor"), F.col("p.amount.min").alias("amount_min"),
                    F.col("p.amount.max").alias("amount_max"), F.col("p.amount.currency").alias("currency"), "p.service_level", "p.local_instrument", "p.charge_bearer")
