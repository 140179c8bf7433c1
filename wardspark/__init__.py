"""Security analytics for AI code, prompts and dependencies as Spark jobs over tables and streams."""
