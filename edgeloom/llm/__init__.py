"""Training-data operators: dedup, token counts, WARC, URL filters, mixing,
language ID, decontamination and toxicity.  Nothing outside this subpackage
imports it."""
