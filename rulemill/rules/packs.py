"""Rule profiles and regulatory metadata."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemill.rules.spec import Rule

# Profiles and the rules of the regional pack.
PROFILES = ("global", "canada", "hybrid")
DEFAULT_PROFILE = "hybrid"
REGIONAL_RULES = (
    "main_language_code_missing",
    "main_language_missing",
    "ca_allergen_evidence_missing_ingredients_text",
    "ca_contains_statement_without_allergen_evidence",
    "ca_fop_required_but_symbol_missing",
    "ca_fop_symbol_present_but_not_required",
    "ca_fop_symbol_present_on_exempt_product",
)

METADATA_SCHEMA = T.StructType([
    T.StructField("rule_name", T.StringType()),
    T.StructField("jurisdiction", T.StringType()),
    T.StructField("profile_tags", T.ArrayType(T.StringType())),
    T.StructField("regulatory_type", T.StringType()),
    T.StructField("legal_citation", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("effective_date", T.StringType()),
    T.StructField("review_status", T.StringType()),
    T.StructField("reviewer", T.StringType()),
    T.StructField("required_fields", T.ArrayType(T.StringType())),
    T.StructField("exemption_logic", T.StringType()),
    T.StructField("rule_notes", T.StringType()),
])

_LAWS = "https://laws-lois.justice.gc.ca/eng/regulations/"
_CA = ("ca", ["canada", "hybrid"])
_DRAFT = ("draft", "pending-mentor-review")
_FOP_FIELDS = ["fop_threshold_exceeded", "fop_symbol_present", "fop_exempt_proxy", "product_is_prepackaged_proxy"]

# Metadata of the regional rules, in the column order of METADATA_SCHEMA.
REGIONAL_METADATA = (
    ("main_language_code_missing", *_CA, "statutory", "SFCR 206(1); FDR B.01.012(2)",
     _LAWS + "SOR-2018-108/section-206.html", "2019-01-15", *_DRAFT, ["lc", "lang", "language_code"],
     "Not all products require bilingual labels; this prototype uses a conservative language-presence proxy.",
     "Canada pack: proxy check for missing primary language code in label metadata."),
    ("main_language_missing", *_CA, "statutory", "SFCR 206(1); FDR B.01.012(2)",
     _LAWS + "C.R.C.,_c._870/section-B.01.012.html", "2019-01-15", *_DRAFT, ["lang", "language_code", "lc"],
     "Prototype proxy only; legal exemptions by product class must be modeled before strict enforcement.",
     "Canada pack: proxy check for missing primary language value."),
    ("ca_allergen_evidence_missing_ingredients_text", *_CA, "statutory_proxy", "FDR B.01.010.1(2); FDR B.01.010.3",
     _LAWS + "C.R.C.,_c._870/section-B.01.010.1.html", "2012-08-04", *_DRAFT,
     ["allergen_evidence_present", "ingredients_text_present", "ingredients_text"],
     "Proxy check: flags records with allergen evidence but no ingredient text present.",
     "Phase-1 Canada allergen rule using OFF-available proxy fields."),
    ("ca_contains_statement_without_allergen_evidence", *_CA, "statutory_proxy", "FDR B.01.010.3(1)(b), (2)",
     _LAWS + "C.R.C.,_c._870/section-B.01.010.3.html", "2012-08-04", *_DRAFT,
     ["contains_statement_present", "allergen_evidence_present"],
     "Proxy check: 'contains' proxy without allergen evidence proxy.",
     "Phase-1 Canada allergen consistency rule."),
    ("ca_fop_required_but_symbol_missing", *_CA, "statutory_proxy", "FDR B.01.350(1)",
     _LAWS + "C.R.C.,_c._870/section-B.01.350.html", "2026-01-01", *_DRAFT, _FOP_FIELDS,
     "Applies only when proxy not exempt and prepackaged proxy is true.",
     "Phase-1 Canada FOP threshold-vs-symbol proxy."),
    ("ca_fop_symbol_present_but_not_required", *_CA, "guidance_proxy", "FDR B.01.350; CFIA FOP guidance",
     "https://inspection.canada.ca/en/food-labels/labelling/industry/nutrition-labelling/fop-nutrition-symbol",
     "2026-01-01", *_DRAFT, _FOP_FIELDS,
     "Proxy warning for symbol present when threshold proxy not exceeded and not exempt.",
     "Phase-1 Canada FOP over-labelling consistency rule."),
    ("ca_fop_symbol_present_on_exempt_product", *_CA, "guidance_proxy", "FDR B.01.350(5)-(15)",
     _LAWS + "C.R.C.,_c._870/section-B.01.350.html", "2026-01-01", *_DRAFT,
     ["fop_symbol_present", "fop_exempt_proxy", "product_is_prepackaged_proxy"],
     "Proxy warning on symbol presence for exempt categories.",
     "Phase-1 Canada FOP exemption consistency rule."),
)
# Metadata of every other rule, from jurisdiction to notes.
DEFAULT_METADATA = {
    "jurisdiction": "global",
    "profile_tags": ["global", "hybrid"],
    "regulatory_type": "off_internal",
    "legal_citation": "",
    "source_url": "",
    "effective_date": "",
    "review_status": "reviewed",
    "reviewer": "prototype",
    "required_fields": [],
    "exemption_logic": "none",
}
DEFAULT_NOTES = "OFF-derived global rule: "


def validate_profile(profile: str) -> str:
    name = profile.strip().lower()
    if name not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; choose one of {', '.join(PROFILES)}")
    return name


def select_rules(rules: Sequence[Rule], profile: str) -> tuple[Rule, ...]:
    name = validate_profile(profile)
    if name == "hybrid":
        return tuple(rules)
    return tuple(r for r in rules if (r.rule_name in REGIONAL_RULES) == (name == "canada"))


def profile_rules(rules: DataFrame, profile: str) -> DataFrame:
    """Rows of any table with a rule_name that belong to a profile."""
    name = validate_profile(profile)
    regional = F.col("rule_name").isin(*REGIONAL_RULES)
    if name == "hybrid":
        return rules
    return rules.where(regional if name == "canada" else ~regional)


def metadata_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGIONAL_METADATA), METADATA_SCHEMA)


def attach_profile_metadata(rules: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Left join of the metadata (seven fixed rows unless given), with the defaults where there is none."""
    meta = F.broadcast(metadata_frame(rules.sparkSession) if metadata is None else metadata)
    joined = rules.join(meta, "rule_name", "left")
    defaults = {
        name: F.coalesce(name, F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, list) else F.lit(value))
        for name, value in DEFAULT_METADATA.items()}
    return joined.withColumns({
        **defaults, "rule_notes": F.coalesce("rule_notes", F.concat(F.lit(DEFAULT_NOTES), F.col("rule_name")))})
