"""Imports every query module so their ``@register`` calls fill the registry."""

from kshot.plans import (q_classify, q_learn, q_nearest, q_pairs, q_permute, q_runlog, q_sampling, q_sources,  # noqa: F401
                         q_stream, q_text, q_vectors)
