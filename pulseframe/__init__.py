"""pulseframe: session-keyed signal and behaviour analytics as lazy Spark plans."""
