"""Watch-list screening and training-data operators as Spark plans."""
