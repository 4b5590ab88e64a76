"""Early-warning risk analytics for loan tables, expressed as Spark plans."""
