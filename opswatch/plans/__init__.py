"""Complete queries: monitoring checks, alert evaluation, investigation pages, reports, PII jobs, maintenance."""
