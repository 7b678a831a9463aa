"""Imports every query module so that they register themselves."""

from curio.plans import (q_curriculum, q_quality, q_ranking, q_text, q_trainlog,  # noqa: F401
                         q_sources, q_streams, q_vectors)
