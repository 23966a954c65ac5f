"""Display ranks of coded columns as expression text."""

from __future__ import annotations

# The order in which levels, priorities and statuses are listed.
STOCKOUT_RANK = """CASE stockout_risk_level WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3
    WHEN 'unknown' THEN 4 ELSE 5 END"""
OVERSTOCK_RANK = "CASE overstock_risk_level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
PRIORITY_RANK = "CASE priority WHEN 'P0' THEN 1 WHEN 'P1' THEN 2 WHEN 'P2' THEN 3 ELSE 4 END"
STATUS_RANK = "CASE task_status WHEN 'pending' THEN 1 WHEN 'resolved' THEN 2 ELSE 3 END"
