"""Analytics over metrics, traces, logs and text corpora as Spark DataFrame operators."""
