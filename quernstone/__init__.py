"""A PySpark engine for catalogue matching, health reports and change-feed synchronisation."""
