"""Structured Streaming forms of scan ingestion, event counting and quotas."""
