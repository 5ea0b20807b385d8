"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import re

from hazeline.llm import alignment, jaccard, language, manifest, mixing, neighbours, pieces, quality, setsketch, substrings, token_counts, token_files, warc

_MODULES = (alignment, jaccard, language, manifest, mixing, neighbours, pieces, quality, setsketch, substrings, token_counts, token_files, warc)

QUERIES = {name: getattr(m, name) for m in _MODULES for name in dir(m) if re.match(r"op\d+_", name)}
SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
