"""Text themes, outcomes and company registry data as Spark DataFrame operators."""
