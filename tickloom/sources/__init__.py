"""Readers and bar builders."""
