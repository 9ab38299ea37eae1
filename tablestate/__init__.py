"""Know the true state of tables and of the changes made to them: DataFrame in, DataFrame out."""
