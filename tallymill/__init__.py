"""A Spark-native engine for verifying and analysing a ledger of financial documents."""
