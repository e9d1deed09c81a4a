"""Point-in-time market research on Spark: DataFrame operators over long-format bars."""
