"""Training-data operators: language labels, page bodies, spam, residue,
near-duplicates, encodings, split leaks, packing, mixing, shared spans.

``queries`` in :mod:`tesserine.llm.queries` registers them; nothing else in the
library imports this package.
"""
