"""ledgerflow: DataFrame operators for event streams, logs and run ledgers on PySpark."""
