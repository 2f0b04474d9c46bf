"""Import every module that registers queries."""
from rulemill.registry import catalog_queries, core, ingest_queries, issue_queries, parity_queries, review_queries, verify_queries, workflow_queries  # noqa: F401
