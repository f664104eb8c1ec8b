"""Plan building blocks: sessions, durable cuts, configured pipelines."""
