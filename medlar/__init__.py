"""medlar: a PySpark-native analytics engine for semester-grain entity histories."""
