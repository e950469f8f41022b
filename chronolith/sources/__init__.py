"""Binary logs and operation files as data sources."""
