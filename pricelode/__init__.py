"""Supplier price reconciliation and corpus preparation as Spark jobs."""
