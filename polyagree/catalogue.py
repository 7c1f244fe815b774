"""Registered queries of the library and the SQL they are held against."""

from __future__ import annotations

from polyagree.plans import agreeing, assembling, building, covering, curating, finding, measuring, reviewing, tabling

QUERIES = agreeing.QUERIES | covering.QUERIES | curating.QUERIES | reviewing.QUERIES | assembling.QUERIES | measuring.QUERIES | building.QUERIES | finding.QUERIES | tabling.QUERIES
ORACLE_SQL = agreeing.ORACLE_SQL | covering.ORACLE_SQL | curating.ORACLE_SQL | reviewing.ORACLE_SQL | assembling.ORACLE_SQL | measuring.ORACLE_SQL | building.ORACLE_SQL | finding.ORACLE_SQL | tabling.ORACLE_SQL
FLAGSHIP = "agreement_within_variant"
