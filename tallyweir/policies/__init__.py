"""Bounded flow tables: who gets a bucket when two flows want it."""
