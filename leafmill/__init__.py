"""Document conversion, normalisation and assembly as Spark DataFrame plans."""
