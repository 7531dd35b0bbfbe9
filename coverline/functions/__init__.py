"""Column functions: text extraction, amounts, lexicon keys, classification. Built-in expressions only."""
