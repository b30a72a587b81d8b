"""Issue signatures and the classification of issue codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 300
# Severity, domain, level, scope and effect, and the codes that have them.
CLASSES = [
    ("BLOCKING", "AUTHORISATION_CONFIG", "STRUCTURE", "DELIVERY", "BLOCK", """
        CONFIG_FORMAT_UNSUPPORTED CONFIG_CHARSET_UNKNOWN CONFIG_DELIMITER_MISSING CONFIG_DELIMITER_INVALID CONFIG_QUOTE_INVALID CONFIG_HEADER_LINE_INVALID
        CONFIG_FIELD_REFERENCE_KIND_INVALID CONFIG_HEADER_REFERENCE_INCONSISTENT CONFIG_IDENTITY_FIELD_MISSING CONFIG_PRICE_FIELD_MISSING CONFIG_COLUMN_COUNT_INVALID
        CONFIG_FIELD_REFERENCE_INVALID CONFIG_CANONICALISATION_VERSION_UNSUPPORTED CONFIG_LINK_CURRENCY_INVALID CONFIG_DISCOUNT_FIELD_MISSING CONFIG_FIELD_NOT_RESOLVED
        CONFIG_MAPPING_TARGET_UNKNOWN CONFIG_MAPPING_SOURCE_UNRESOLVED CONFIG_MAPPING_DUPLICATE_TARGET CONFIG_MAPPING_TYPE_INCOMPATIBLE CONFIG_FIELD_MAPPING_DUPLICATES_REVISION
        CONFIG_IDENTITY_CLASS_CONFLICT CONFIG_OWNER_NOT_CHANGEABLE CONFIG_PRICE_COMPONENT_DUPLICATE CONFIG_TRANSFORM_INVALID CONFIG_FILTER_INVALID
        CONFIG_CANONICALISATION_VERSION_REQUIRED CONFIG_FIELD_CRITICALITY_INVALID CONFIG_PRICE_CONTROL_MODEL_UNSUPPORTED"""),
    ("BLOCKING", "STRUCTURE_DATASET", "STRUCTURE", "DELIVERY", "BLOCK", """
        CONFIG_COLUMN_INDEX_OUT_OF_RANGE HEADER_LINE_MISSING HEADER_FIELD_MISSING HEADER_DUPLICATE_FIELD HEADER_COLUMN_COUNT_MISMATCH HEADER_FIELD_SEMANTIC_CHANGE FILTER_COLUMN_MISSING"""),
    ("WARNING", "STRUCTURE_DATASET", "STRUCTURE", "DELIVERY", "NONE", "SOURCE_BOM_REMOVED HEADER_FIELD_SHIFTED HEADER_UNKNOWN_COLUMN"),
    ("BLOCKING", "STRUCTURE_DATASET", "DELIVERY", "DELIVERY", "BLOCK", "SOURCE_FILE_EMPTY SOURCE_NO_DATA_RECORDS"),
    ("BLOCKING", "DELIVERY_SOURCE", "DELIVERY", "DELIVERY", "BLOCK", "BYTE_SIZE_MISMATCH RECORD_COUNT_MISMATCH"),
    ("BLOCKING", "IDENTITY_REFERENCE", "DELIVERY", "DELIVERY", "BLOCK", "DUPLICATE_IDENTITY_IN_DELIVERY IDENTITY_HASH_COLLISION"),
    ("BLOCKING", "PUBLICATION_TECHNICAL", "DELIVERY", "DELIVERY", "BLOCK", "SCREENING_FAILED SCREENING_INTERRUPTED"),
    ("INFO", "PUBLICATION_TECHNICAL", "DELIVERY", "DELIVERY", "NONE", "ROW_ISSUE_RECORDING_CAPPED"),
    ("ERROR", "STRUCTURE_DATASET", "RECORD", "RECORD", "NONE", "ROW_COLUMN_COUNT_MISMATCH ROW_TOO_LONG CSV_UNCLOSED_QUOTE"),
    ("ERROR", "MAPPING_VALIDATION", "RECORD", "RECORD", "NONE", """
        VALUE_MISSING CANONICAL_CONTROL_CHARACTER VALUE_TOO_LONG VALUE_TYPE_MISMATCH DATE_UNREADABLE DATE_AMBIGUOUS TRANSFORM_FAILED TRANSFORM_DIVIDE_BY_ZERO MAPPING_VALUE_UNKNOWN FILTER_RECORD_REJECTED"""),
    ("ERROR", "IDENTITY_REFERENCE", "RECORD", "RECORD", "NONE", "IDENTITY_COMPONENT_EMPTY"),
    ("INFO", "MAPPING_VALIDATION", "RECORD", "RECORD", "NONE", "VALUE_DEFAULT_APPLIED"),
    ("ERROR", "PRICE", "RECORD", "RECORD", "NONE", """
        PRICE_MISSING PRICE_UNREADABLE PRICE_SCALE_EXCEEDED PRICE_OUT_OF_RANGE PRICE_ZERO_NOT_ALLOWED PRICE_NEGATIVE_NOT_ALLOWED PRICE_CURRENCY_MISMATCH
        PRICE_PERCENTAGE_NOT_COMPUTABLE PRICE_DERIVATION_MISMATCH PRICE_PERCENTAGE_OUT_OF_RANGE"""),
    ("WARNING", "PRICE", "RECORD", "RECORD", "NONE", "PRICE_DEVIATION_EXCEEDED"),
    ("INFO", "PRICE", "DELIVERY", "DELIVERY", "NONE", "PRICE_REFERENCE_NOT_AVAILABLE"),
    ("CRITICAL", "IDENTITY_REFERENCE", "RECORD", "RECORD", "REVIEW", "IDENTITY_REFERENCE_INCIDENT DUPLICATE_REFERENCE_IN_DELIVERY"),
    ("INFO", "IDENTITY_REFERENCE", "RECORD", "RECORD", "NONE", "REFERENCE_LINK_PROPOSED"),
    ("BLOCKING", "PRICE", "DELIVERY", "DELIVERY", "REVIEW", "BULK_PRICE_INCIDENT"),
    ("CRITICAL", "IDENTITY_REFERENCE", "DELIVERY", "DELIVERY", "REVIEW", "BULK_IDENTITY_INCIDENT"),
    ("BLOCKING", "DELIVERY_SOURCE", "DELIVERY", "DELIVERY", "REVIEW", "INITIAL_LOAD_REQUIRES_APPROVAL BULK_CREATION_INCIDENT"),
    ("BLOCKING", "DELIVERY_SOURCE", "DELIVERY", "DELIVERY", "BLOCK", "CRITICAL_RECORD_THRESHOLD_EXCEEDED REJECTED_RECORD_THRESHOLD_EXCEEDED"),
]
CATALOGUE = [(code, *of) for *of, codes in CLASSES for code in codes.split()]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "code string, severity string, domain string, level string, scope string, effect string")


def catalogued(found: DataFrame) -> DataFrame:
    """Issues with what the catalogue says of their code, without its argument. Codes that it doesn't know stay, as errors without an effect: ``catalogued`` is false."""
    known = F.broadcast(catalogue(found.sparkSession).withColumn("catalogued", F.lit(True)))
    rows = found.drop("severity", "domain", "level", "scope", "effect").withColumn("code", base_code(F.col("code"))).join(known, "code", "left")
    return rows.withColumn("severity", F.coalesce("severity", F.lit("ERROR"))).withColumn("catalogued", F.coalesce("catalogued", F.lit(False)))


def base_code(code: Column) -> Column:
    """A code without the argument after its colon."""
    return F.split_part(code, F.lit(":"), F.lit(1))


def signature(*pairs: tuple[str, Column]) -> Column:
    """NAME=value parts joined by ``|``, cut at 300; parts without a value are left out."""
    return F.substring(F.concat_ws("|", *(F.when(v.isNotNull(), F.concat(F.lit(f"{n}="), v)) for n, v in pairs)), 1, LONGEST)
