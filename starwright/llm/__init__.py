"""Training-data operators: de-duplication, tokens, packing, scoring and chat
formatting for text corpora.  Nothing else in the package imports this one."""
