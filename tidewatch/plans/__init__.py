"""Whole watches as logical plans, and the registered queries."""
