"""Analytics over recorded vehicle-trajectory logs, written as Spark DataFrame plans."""
