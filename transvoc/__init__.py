"""transvoc: a Spark-native engine for tokenizer-transfer corpus analytics.

Sub-packages:

* ``sources``   - scans and sinks (text corpora, JSON manifests, nested metrics);
* ``functions`` - scalar column functions (strip, byte length, halves, ...);
* ``operators`` - the DataFrame jobs (sampling, vocabularies, tokenization,
  packing, count language models, scoring, embedding transfer, reports);
* ``plans``     - experiment plans (language pairs, fine-tuning and evaluation
  plans, data routing, the full metric matrix);
* ``streaming`` - intentionally empty: the workload has no unbounded input.
"""

__version__ = "0.1.0"
