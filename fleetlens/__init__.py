"""Fleet telemetry analytics as Spark jobs: captures in, typed tables, rates, snapshots and payloads out."""
