"""Reusable DataFrame operators: latest row per key, sequence rules, paging, filters, rule matching."""
