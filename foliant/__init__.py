"""Page text and recorded model replies to audited tables, as Spark operators."""
