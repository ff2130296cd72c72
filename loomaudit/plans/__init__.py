"""Judgements and reports: rules, findings, summaries, comparisons."""
