"""Operators on the normalized tables (takes, defects, spans, frames, usage,
gold, answers, jobs).  ``clip`` is the key throughout."""
