"""Column expressions: text, links, tokenizers."""
