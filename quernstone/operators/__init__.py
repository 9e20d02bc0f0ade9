"""Relational operators: reports, identifier lanes, matching, evaluation, health checks, synchronisation."""
