"""newsloom: a Spark-first analytics engine for news, facts and text corpora."""
