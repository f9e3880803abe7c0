"""meshwright: multi-tenant connected components over an ordered edge log, on PySpark."""
