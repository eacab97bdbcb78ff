"""Analytics over guided-dialogue runs: ledgers, transcripts, text rules, documents and alerts on Spark."""
