"""Training-data operators: filters, deduplication, mixing and token counts over document tables."""
