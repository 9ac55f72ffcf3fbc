"""Timeline alignment as Spark jobs: match, compare, align, re-time, plan and report."""
