"""Set-based operators over sources, articles, stories, owners, readers and pipeline state."""
