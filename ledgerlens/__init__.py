"""ledgerlens: statement-risk and document analytics as Spark DataFrame plans."""
