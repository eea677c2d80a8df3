"""verisieve: code-claim analytics and corpus preparation on Spark DataFrames."""
