"""galley: Spark jobs for grounding and grading editorial text."""
