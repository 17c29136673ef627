"""The incremental jobs as streams; each batch is the batch operator's own transition."""
