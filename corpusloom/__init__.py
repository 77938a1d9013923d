"""corpusloom: corpus analytics for language-model data, expressed as Spark DataFrame plans."""
