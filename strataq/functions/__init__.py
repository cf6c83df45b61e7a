"""Column expressions and the few Arrow-batched codecs."""
