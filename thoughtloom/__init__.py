"""Memory-graph analytics as Spark DataFrame operators.

Chat logs, transcripts and notes become fragments, fragments become atoms,
atoms are linked by shared tags, rolled up into notes, kept warm or cold by
an activation score, and served back by focus / latent retrieval.
"""
