"""tripledger: expense reconciliation over many business trips, as Spark DataFrame operators."""
