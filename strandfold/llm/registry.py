"""The queries and the SQL of all operators in this folder."""

from __future__ import annotations

from strandfold.llm import bpe, decontam, imatch, lines, quality, repeats, setsketch, sharding, token_files, warc

MODULES = [bpe, decontam, imatch, lines, quality, repeats, setsketch, sharding, token_files, warc]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
