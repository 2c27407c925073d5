"""Operators on bars."""
