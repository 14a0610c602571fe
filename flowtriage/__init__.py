"""Network-flow triage analytics expressed as PySpark DataFrame operators."""
