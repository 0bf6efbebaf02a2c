"""All registered queries of the subpackage (op1 to op13)."""

from . import centroids, decontam, filter_audit, fingerprint, html_text, jaccard, langid, mixing, neighbours, quality, secrets, substrings, tokenout  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
