"""contactlake: contact-record ingestion, healing and resolution on Spark."""
