"""DataFrame-to-DataFrame operators: reads, merges, ledger, alerts, telemetry."""
