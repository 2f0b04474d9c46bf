"""rulemill: rule-based data quality, review and correction on Spark DataFrames."""
