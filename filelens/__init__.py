"""Analytics over file inventories, expressed as Spark DataFrame operators."""
