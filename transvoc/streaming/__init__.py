"""No streaming operators.

The workload reads finite corpora, manifests and metric files only; there are
no unbounded sources, watermarks, event-time windows or stateful operators to
reproduce, so nothing is built on Structured Streaming.  Every job here is a
batch DataFrame plan and can be rerun from its inputs.
"""
