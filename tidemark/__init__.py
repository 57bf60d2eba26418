"""tidemark: event-study, entity-matching and evidence analytics as Spark DataFrame operators."""
