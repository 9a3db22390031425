"""Relational operators: cells, profile, detectors, findings, rules, context, windows, history, audit."""
