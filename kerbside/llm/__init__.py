"""Training-data operators: filters, de-duplication, tokenizing, packing and sharding of a document corpus.

Every operator takes a DataFrame with at least doc_id (long) and text (string) and reads only the columns it names, so
extra columns, whatever they are called, change nothing. `kerbside.llm.queries` holds one query per operator.
"""
