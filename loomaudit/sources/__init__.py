"""What the auditor reads: page snapshots, robots files, sitemaps, probes."""
