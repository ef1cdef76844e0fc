"""logloom: gateway-log, security-scan and text analytics on PySpark DataFrames."""
