"""Nothing is streamed: the engine is batch only.  Batches of input are folders of Parquet or CSV."""
