"""Session helpers and tables that cut lineage."""
