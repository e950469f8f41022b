"""Building blocks: snapshots, reads, change logs, conflicts, retention."""
