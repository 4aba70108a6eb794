"""Exports of the engine."""
