"""Registered queries: operators bound to the canonical views, each with its SQL."""
