"""Training-data operators: personal data, de-duplication, packing, classifiers, decontamination.

Nothing outside this package, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
